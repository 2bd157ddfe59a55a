"""Page statistics, furniture, headings, chapters and the order of source documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import lineage
from corpusmill.operators.corpus import in_ranges, numbered
from corpusmill.operators.folds import folded

#: Least shares of usable pages, of all and of scans, and most of replacement characters; fixed values.
USABLE_PAGES, USABLE_SCANS, MOST_REPLACED = 0.60, 1.00, 0.02
#: Least share of pages with large images from which these are looked at; fixed value.
IMAGE_SHARE = 0.1
#: Names of scanning software in a file's producer or creator; fixed values.
SCANNERS = ["paper capture", "abbyy"]
#: Page footers that are page labels, and those with substance; fixed patterns.
PAGE_LABEL = r"(?:page\s+)?(?:[0-9]{1,6}|[ivxlcdm]{1,16})"
LINKED = r"https?://|\bwww\s*\.|\bdoi\b"
NOTE_LEAD = r"(?:[*†‡]+\s*)?(?:[0-9]{1,4}|[a-z])[.)]\s+\S"
CITING_LEAD = r"(?:id\.|ibid\.|see\b|accord\b|cf\.\s|supra\b|infra\b)"
REPORTED = r"\b[0-9]{1,4}\s+[A-Z][A-Za-z. '&-]{0,28}\s+[0-9]{1,6}\b"
#: Names of a book's files; fixed patterns.
CHAPTER_FILE = r"^ch(\d+)(?:_[\w-]+)?\.md$"


def page_stats(pages: DataFrame) -> DataFrame:
    """doc, total_pages, usable_pages, scan_pages, usable_scans, text_chars and replacement_chars of (doc, text, large_image) pages."""
    own = pages.select("doc", "text", "large_image", X.usable_page(F.col("text")).alias("usable"))
    n = lambda c: F.count(F.when(c, 1))
    replaced = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    return own.groupBy("doc").agg(F.count("*").alias("total_pages"), n(F.col("usable")).alias("usable_pages"), n(F.col("large_image")).alias("scan_pages"), n(F.col("large_image") & F.col("usable")).alias("usable_scans"), F.sum(F.length("text")).alias("text_chars"), F.sum(replaced).alias("replacement_chars"))


def text_layer_usable(scans_only: bool = False) -> Column:
    """Whether the extracted text of a document (see page_stats) can stand without recognition."""
    total, usable, least = ("scan_pages", "usable_scans", USABLE_SCANS) if scans_only else ("total_pages", "usable_pages", USABLE_PAGES)
    share = F.col(usable) / F.nullif(F.col(total), F.lit(0)) >= least
    clean = F.col("replacement_chars") / F.greatest(F.col("text_chars"), F.lit(1)) <= MOST_REPLACED
    every_scan = F.lit(scans_only) | (F.col("scan_pages") == 0) | (F.col("usable_scans") == F.col("scan_pages"))
    return F.when(F.col(total) <= 0, True).otherwise(share & clean & every_scan)


def triage(stats: DataFrame) -> DataFrame:
    """``stats`` with text_layer_usable, unusable_pages, forecast, scanner and ocr_recommended; producer and creator name the software."""
    software = F.lower(F.concat_ws(" ", "producer", "creator"))
    scanner = F.coalesce(*[F.when(F.contains(software, F.lit(s)), s) for s in SCANNERS])
    few = F.col("scan_pages") / F.greatest(F.col("total_pages"), F.lit(1)) < IMAGE_SHARE
    forecast = F.when(few, "no-preprocess").when(F.col("usable_scans") == 0, "keep-for-ocr").otherwise("strip-backgrounds")
    own = stats.withColumn("text_layer_usable", text_layer_usable())
    return own.select("*", F.greatest(F.col("total_pages") - F.col("usable_pages"), F.lit(0)).alias("unusable_pages"), forecast.alias("forecast"), scanner.alias("scanner"), (~F.col("text_layer_usable")).alias("ocr_recommended"))


def footer_kinds(footers: DataFrame) -> DataFrame:
    """``footers`` (doc, ref, text) with kind: page_label, substantive (a link, note or citation, or rare prose of six words) or furniture."""
    compact, canonical = X.one_spaced(F.col("text")), X.fingerprint(F.col("text"))
    counts = footers.select("doc", canonical.alias("__k")).where("__k <> ''").groupBy("doc", "__k").agg(F.count("*").alias("__n"))
    own = footers.withColumn("__t", compact).withColumn("__k", canonical).join(counts, ["doc", "__k"], "left")
    t = F.col("__t")
    cited = X.rlike(t, LINKED, "i") | X.rlike(t, rf"\A(?:{NOTE_LEAD})", "i") | X.rlike(t, rf"\A(?:{CITING_LEAD})", "i") | X.rlike(t, REPORTED)
    prose = (F.coalesce("__n", F.lit(0)) < 3) & (F.size(F.split(t, " ")) >= 6)
    kind = F.when(X.rlike(t, rf"\A(?:{PAGE_LABEL})\z", "i"), "page_label").when((t != "") & (cited | prose), "substantive").otherwise("furniture")
    return own.withColumn("kind", kind).drop("__t", "__k", "__n")


def outside_ranges(pages: DataFrame, ranges: DataFrame, group: str = "doc") -> DataFrame:
    """``pages`` (group, page) that no structural range (group, start_page, end_page) of their group holds."""
    held = in_ranges(pages.select(group, "page").distinct(), ranges.select(group, "start_page", "end_page"), group).select(group, "page").distinct()
    return pages.join(held, [group, "page"], "left_anti")


def body_size(spans: DataFrame, least: int = 5) -> DataFrame:
    """doc and size: the font size of most text, over (doc, ord, text, size) spans of at least ``least`` characters; the first seen among equals."""
    own = spans.select("doc", "ord", F.round("size", 1).alias("size"), F.length(X.stripped(F.col("text"))).alias("n")).where(F.col("n") >= least)
    sums = own.groupBy("doc", "size").agg(F.sum("n").alias("n"), F.min("ord").alias("first"))
    return sums.groupBy("doc").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("size"))


def with_chapters(records: DataFrame, group: str, order: str, chapter: Column) -> DataFrame:
    """``records`` with chapter: their own, else that of the last record before them that has one."""
    own = numbered(records.withColumn("__own", chapter), group, [order], lasts={"__last": F.col("__own")})
    return own.withColumn("chapter", F.coalesce("__own", "__last")).drop("__own", "__last", "number")


def chapter_headers(pages: DataFrame, own, context: str = "page_header") -> DataFrame:
    """doc, page, chapter and title of the pages (doc, page, header) whose header names a division of the profile ``own``; the first it names counts."""
    from corpusmill.operators.divisions import found_divisions

    found = pages.select("doc", "page", F.try_element_at(found_divisions(F.col("header"), own, context), F.lit(1)).alias("d"))
    return found.where("d is not null").select("doc", "page", F.col("d.ordinal").alias("chapter"), F.col("d.title").alias("title"))


def chapter_map(headers: DataFrame) -> DataFrame:
    """doc, chapter, title, first_page and last_page of (doc, page, chapter, title) page headers; the first title counts."""
    return headers.where("chapter is not null").groupBy("doc", "chapter").agg(F.min_by("title", "page").alias("title"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def section_ranges(sections: DataFrame, pages: int) -> DataFrame:
    """``sections`` (doc, page, name) with end_page: before the next boundary on a later page, else ``pages``."""
    later = F.min("page").over(W.partitionBy("doc").orderBy("page").rangeBetween(1, W.unboundedFollowing))
    return sections.withColumn("end_page", F.coalesce(later - 1, F.lit(pages)))


@dataclass
class _Run:
    """The run of records that is open: its first record, its words (one more than allowed stands for all beyond) and whether it may go on."""

    first: int | None = None
    words: int = 0
    open: bool = False


def _joined(run: _Run, at: int, words: int, stops: bool, most: int) -> _Run:
    if run.open and run.words + words <= most:
        return _Run(run.first, run.words + words, not stops)
    return _Run(at, min(words, most + 1), not stops)


def joined_leads(records: DataFrame, group: str, order: str, most_words: int) -> DataFrame:
    """group, first, n_records and text: runs of records joined while the lead lacks a full stop and the words stay within ``most_words``.

    ``order`` is a long, unique in its group.  What a run becomes depends on the runs before it, but of these only on how many words are open:
    a stretch of records is summed up by what it makes of each number of words, so a group may lie in many tasks (``folds``).  Only
    counts pass through them; the texts of a run, which is as short as ``most_words`` says or one record, meet by its first record.
    """
    text = F.coalesce("text", F.lit(""))
    told = records.select(group, F.col(order).cast("long").alias("at"), text.alias("text"))
    sized = told.select(group, "at", X.word_count(F.col("text")).alias("n"), F.coalesce(X.stripped(F.col("text")).endswith("."), F.lit(False)).alias("stops"))
    states = [_Run(None, 0, False), *[_Run(None, w, True) for w in range(most_words + 2)]]

    def step(run: _Run, row: dict) -> _Run:
        return _joined(run, row["at"], row["n"], row["stops"], most_words)

    def summary(rows: Iterable[dict]) -> list[_Run]:
        place, ends = list(range(len(states))), list(states)
        for row in rows:
            ends = [step(run, row) for run in ends]
            if len(ends) > 1:  # states that have become one stay one
                known: dict[tuple, int] = {}
                to = [known.setdefault((e.first, e.words, e.open), len(known)) for e in ends]
                ends, place = [next(e for e, k in zip(ends, to) if k == i) for i in range(len(known))], [to[p] for p in place]
        return [ends[p] for p in place]

    def after(run: _Run, own: list[_Run]) -> _Run:
        made = own[run.words + 1 if run.open else 0]
        return _Run(run.first if made.first is None else made.first, made.words, made.open)

    def walk(run: _Run, rows: Iterable[dict]) -> Iterator[tuple]:
        for row in rows:
            run = step(run, row)
            yield row[group], row["at"], run.first

    kinds = dict(records.dtypes)
    runs = folded(sized, group, ["at"], _Run(), summary, after, walk, f"`{group}` {kinds[group]}, at long, first long")
    same = F.col(f"x.{group}").eqNullSafe(F.col(f"y.{group}")) & (F.col("x.at") == F.col("y.at"))
    both = told.alias("x").join(runs.alias("y"), same).select(F.col(f"x.{group}").alias(group), "y.first", "x.at", "x.text")
    parts = both.groupBy(group, "first").agg(F.count("*").alias("n_records"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    return parts.select(group, F.col("first").cast(kinds[order]).alias("first"), "n_records", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def questions(records: DataFrame, group: str, order: str) -> DataFrame:
    """group, order, place, question and before: the questions of notes records, each with the record before as its context.

    The record before is handed on over ranges, so a group may lie in many tasks.
    """
    placed = numbered(records.select(group, order, "content_type", "text"), group, [order], lasts={"__b": F.struct("text")})
    own = placed.withColumn("before", F.col("__b.text")).where("content_type = 'notes_and_questions'")
    asked = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"([^.?!]*\?)"), F.lit(1)), X.one_spaced), lambda q: F.length(q) > 1)
    return own.select(group, order, "before", F.posexplode(asked).alias("place", "question"))


def file_order(name: Column) -> Column:
    """Where a file of a book stands: front matter, chapters by number, back matter; any other name is an error."""
    number = F.regexp_extract(name, CHAPTER_FILE, 1)
    unknown = F.raise_error(F.concat(F.lit("not a file of a book: "), name))
    return F.when(name == "front_matter.md", F.struct(F.lit(0).alias("part"), F.lit(0).alias("number"))).when(number != "", F.struct(F.lit(1).alias("part"), number.cast("int").alias("number"))).when(name == "back_matter.md", F.struct(F.lit(2).alias("part"), F.lit(0).alias("number"))).otherwise(unknown)


def chapter_key(value: Column) -> Column:
    """Numbers before other names, numbers by size."""
    number = value.cast("string").try_cast("double")
    return F.struct(F.when(number.isNotNull(), 0).otherwise(1).alias("kind"), number.alias("number"), F.when(number.isNull(), value.cast("string")).alias("name"))


def book_pairs(scaffolds: DataFrame, pdfs: DataFrame) -> DataFrame:
    """scaffold and pdf: the file of the same stem whatever its case, else one whose stem begins so.

    Both have path, folder and stem.  Among several the same folder comes first, then the path.  Stems meet by their first
    characters, so prefixes need no comparison of all with all.
    """
    s = scaffolds.select(F.col("path").alias("scaffold"), F.col("folder").alias("sf"), F.lower("stem").alias("base"))
    width = s.agg(F.max(F.length("base"))).first()[0] or 0
    p = pdfs.select(F.col("path").alias("pdf"), F.col("folder").alias("pf"), F.lower("stem").alias("full"))
    starts = p.select("*", F.explode(F.sequence(F.lit(1), F.least(F.length("full"), F.lit(max(width, 1))))).alias("n")).select("*", F.substr("full", F.lit(1), F.col("n")).alias("base"))
    both = s.join(starts, "base")
    place = W.partitionBy("scaffold").orderBy(F.col("full") != F.col("base"), F.col("pf") != F.col("sf"), F.lower("pdf"))
    return both.withColumn("__r", F.row_number().over(place)).where("__r = 1").select("scaffold", "pdf")


def running_headers(items: DataFrame, margin: float = 0.12, near: float = 12.0) -> DataFrame:
    """doc and ref of section headings that are page furniture.

    ``items``: doc, ref, page, label (section_header or page_header), top, ratio (distance from the page's top over its height),
    text.  A heading is furniture if a page header of its page stands within ``near`` points; or if it stands in the top margin and
    its words, digits aside, do so on two pages or more; or if, there, it ends in a number and the rest is another heading.
    """
    family = F.lower(X.one_spaced(F.regexp_replace("text", r"\d+", " ")))
    own = items.withColumn("__f", family)
    heads = own.where("label = 'section_header'")
    marks = own.where("label = 'page_header'").select(F.col("doc").alias("d"), F.col("page").alias("p"), F.col("top").alias("t"))
    aligned = heads.join(marks, (F.col("doc") == F.col("d")) & (F.col("page") == F.col("p")) & (F.abs(F.col("top") - F.col("t")) <= near), "left_semi")
    high = heads.where(F.col("ratio") <= margin)
    many = high.where("__f <> ''").groupBy("doc", "__f").agg(F.countDistinct("page").alias("n")).where("n >= 2").select("doc", "__f")
    repeated = high.join(many, ["doc", "__f"], "left_semi")
    rest = F.lower(F.regexp_extract("text", r"^(.*\S)\s+\d{1,4}$", 1))
    others = heads.select(F.col("doc").alias("d"), F.lower(X.one_spaced(F.col("text"))).alias("t"), F.col("ref").alias("r"))
    numbered_ = high.withColumn("__rest", rest).where("__rest <> ''").join(others, (F.col("doc") == F.col("d")) & (F.col("__rest") == F.col("t")) & (F.col("ref") != F.col("r")), "left_semi")
    found = [df.select("doc", "ref") for df in (aligned, repeated, numbered_)]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def heading_scopes(items: DataFrame, group: str, order: str) -> DataFrame:
    """group, order and path: the titles of the headings in force at every item, from the outermost in.

    ``items``: group, order, level (of any depth, null for body), title.  A heading ends those of its level and below.
    """
    paths = lineage.heading_paths(items.select(group, order, "level"), group, order, nested=False)
    titles = items.where("level is not null").select(group, F.col(order).alias("__h"), "title")
    named = paths.select(group, order, F.posexplode("path").alias("__d", "__h")).join(titles, [group, "__h"])
    joined = named.groupBy(group, order).agg(F.array_sort(F.collect_list(F.struct("__d", "title"))).alias("__t"))
    path = F.array_join(F.transform("__t", lambda x: x["title"]), " > ")
    return paths.select(group, order).join(joined, [group, order], "left").select(group, order, F.coalesce(path, F.lit("")).alias("path"))


def page_regressions(records: DataFrame, group: str, order: str) -> DataFrame:
    """group, order, days back and allowed of records whose page is before the last one's.

    ``records``: page, content_type, section_path, content_source, reason.  Allowed: author's narrative after the statute it
    explains, in the same section; and a footnote kept back by one page to end a sentence.
    """
    held = ("page", "content_type", "section_path", "content_source")
    placed = numbered(records.where("page is not null"), group, [order], lasts={"__b": F.struct(*held)})
    own = placed.withColumns({f"__{c}": F.col(f"__b.{c}") for c in held})
    back = own.where("page < __page")
    lane = (F.col("section_path") != "") & F.col("section_path").eqNullSafe(F.col("__section_path")) & (F.col("__content_type") == "statutory_excerpt") & (F.col("content_type") == "author_narrative")
    note = (F.col("__page") == F.col("page") + 1) & (F.col("__content_source") == "body") & (F.col("content_source") == "footnote") & (F.col("content_type") == "footnote") & (F.col("reason") == "footnote_after_continuation")
    return back.select(group, order, (F.col("__page") - F.col("page")).alias("pages_back"), F.when(F.coalesce(lane, F.lit(False)), "semantic_lane").when(F.coalesce(note, F.lit(False)), "cross_page_footnote").alias("allowed"))
