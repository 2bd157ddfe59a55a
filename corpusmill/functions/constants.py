"""Fixed values of the retrieval and classification semantics."""

#: Stop words of the offline ranking; fixed values.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "because", "been", "but",
    "by", "can", "could", "did", "do", "does", "for", "from", "had", "has",
    "have", "how", "if", "in", "into", "is", "it", "its", "may", "must",
    "not", "of", "on", "or", "that", "the", "their", "this", "to", "under",
    "was", "were", "what", "when", "where", "whether", "which", "who",
    "why", "will", "with", "would",
]

#: Words a query may leave out under the function-words policy; fixed values.
FUNCTION_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "did", "do",
    "does", "for", "from", "had", "has", "have", "in", "into", "is", "it",
    "its", "of", "on", "or", "that", "the", "their", "this", "to", "was",
    "were", "with", "what", "which", "who", "how", "his", "her", "he",
    "she", "they", "them", "there", "these", "those", "i", "you", "we",
]

#: Words and numbers of the search analyser; fixed pattern.
WORD = r"[a-z]+(?:'[a-z]+)?|\d+(?:\.\d+)?"

#: Lines that head pages without substance; matched without case at each line; fixed patterns.
STRUCTURAL_LINES = [
    r"^(Table of )?Contents$",
    r"^(?:Summary|Brief|Short|Detailed) (?:of )?Contents$",
    r"^Table of Problems$",
    r"^Table of Cases$",
    r"^Table of (?:Rules|Authorities|Restatements|Statutes|Bar Opinions|Standards)(?:,.*)?$",
    r"^Index$",
    r"^Acknowledgments?$",
    r"^About the Authors?$",
    r"^About .*Publishing$",
    r"^Major products, programs, and initiatives include:?$",
    r"^Textual material$",
    r"^Images$",
    r"^Design \(chapter opener graphic\)$",
    r"^(Series |Editorial )?Advisory Board$",
    r"^Editorial Advisors?$",
]
#: Copyright notices, without case, the first across lines; fixed patterns.
STRUCTURAL_TEXTS = [
    r"(?s)Copyright\s+(?:©|\(c\)).{0,250}\bAll rights reserved\b",
    r"\bNo part of this publication may be reproduced or transmitted\b",
]
#: Lines of a table of contents and of an index, at each line; fixed patterns.
TOC_LINE = r"^.{5,80}\s+\d{1,4}\s*$"
INDEX_LINE = r"^[A-Z].{2,60},\s*\d{1,4}(?:[-,]\s*\d{1,4})*\s*$"
#: Headings by kind; fixed patterns.
NOTES_HEADING = r"^(?:Notes?\s+(?:and|&)\s+Questions?|Questions?)\b"
PROBLEM_HEADING = r"^\s*(?:PROBLEM\s+\d+(?:\s*-\s*\d+)+|HYPOTHETICAL\b)"
CHAPTER_HEADING = r"^(?:Chapter\s+)?(\d{1,2})\s*[·\-•–—]\s*(.+)$"
INTRODUCTION = r"\bIntroduction\b"
DIRECT_INTRODUCTION = r"^\s*(?:§\s*)?(\d{1,2})\s*\.\s*0?1\s+Introduction\b"
CHAPTER_NUMBER = r"^\s*(?:Chapter\s+)?(\d{1,2})\b"
RULE_HEADING = r"(?:rule language|statutory text|text of (?:the )?(?:rule|statute)(?:\s+\d+(?:\.\d+)*)?|model rule\s+\d+(?:\.\d+)*|code provision|regulatory text)\s*\**"
EXPLANATION_HEADING = r"(?:authors?['’] explanation|commentary|analysis)\s*\**"
STATUTE_OPENING = r"^\s*(?:Under\s+)?(?:\d+\s+U\.S\.C\.\s+§|(?:Model\s+)?Rule\s+\d+(?:\.\d+)*\b|Rule language\s*\**(?:\s|$)|§+\s*\d+)"
#: Where a footnote starts, at each line; fixed pattern.
FOOTNOTE_START = r"^\s*(?:\d{1,3}[.\)]\s|[¹²³⁰-⁹]+\s|\[\d{1,3}\]\s)"
#: Words of citing, with case; fixed values.
CITING_WORDS = ["Id.", "id.", "supra", "infra", "See ", "see ", "Cf.", "cf.", "e.g.,", "Compare "]

#: A party of a case and the captions made of parties; fixed patterns.
CASE_WORD = r"(?:[A-Z][A-Za-z&'’.\-]*|[A-Z]{2,})"
CASE_JOINER = r"(?:of|the|for|and|&|ex\s+rel\.)"
CASE_PARTY = rf"{CASE_WORD}(?:\s+{CASE_WORD}|\s+{CASE_JOINER}\s+{CASE_WORD}){{0,8}}"
CASE_NAME = rf"\b((?:In re|Ex parte)\s+{CASE_PARTY}|{CASE_PARTY}\s+v\.\s+{CASE_PARTY})"
#: Words before a caption, taken off in this order; fixed values.
CASE_SIGNALS = ["See ", "see ", "Cf. ", "cf. ", "Compare ", "In ", "But see ", "E.g., ", "After ", "How "]
#: Titles of articles on a case, before and after its name; fixed patterns.
ARTICLE_LEAD = r"^(?:(?:A|An|The)\s+)?(?:Study|Studies|Fifty\s+Years|Legacy|Lessons|Impact|Effects?)\b.*\b(?:How|After|From)\s+(.+)$"
ARTICLE_TAIL = r"\s+(?:Affected|Changed|Transformed|Revisited|Reshaped|Aftermath)\b.*$"

#: What heading cleanup takes off; fixed patterns.
SPACED_HYPHEN = r"(?<=[A-Za-z0-9])-\s+(?=[A-Za-z0-9])"
CHAPTER_SUFFIX = r"\s+(?=Chapter\s+\d{1,2}\s*(?:[·\-•–—:]|$)).*$"
DOT_LEADER = r"(?:\s*[.…·]){3,}\s*(?:\d{1,4})?\s*$"
PAGE_SUFFIX = r"\s+p(?:age)?\.?\s*\d{1,4}\s*$"
TABULAR_HEADING = r"(?:\bN/?A\b.*\d|\d(?:\.\d+)?\s+\d(?:\.\d+)?\s+\bN/?A\b)"
#: Headings that are body text, and running banners; fixed patterns.
PINPOINT_CITATION = r"(?:(?:Id\.|Ibid\.)\s+at\s+\d+(?:[-–]\d+)?|\d+\s+(?:Trial|Tria1)\s+at\s+\d+(?:[-–]\d+)?)\.?"
NUMBERED_SENTENCE = r"^\d+\)\s+[a-z]"
OUTLINE_LEAD = r"^(?:Chapter|Part|Unit)\b|^§|^(?:[IVXLCDM]+|[A-Z]|\d+|[a-z])\."
DIVISION_BANNER = r"^(?:\d{1,4}\s+)?\d{1,2}\s*[·•]\s+[A-Z][A-Z0-9 &'’,.:()\-/]{4,}$"
#: Square glyphs alone on their lines; fixed pattern.
SQUARES = r"(?:[^\S\n]*\n)*[ \t]*■[■ \t]*(?:\n(?:[ \t]*■[■ \t]*|[^\S\n]*))*"

#: Rules of text normalisation; fixed values and patterns.
PLAIN_CHARACTERS = {"\xa0": " ", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": " - ", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "\ufffd": ""}
ZERO_WIDTH = r"[\u200b\u200c\u200d\u2060\ufeff]"
UNSAFE_SCHEME = r"(?:javascript|vbscript|data|file)(?::|\\:|&#(?:0*58|x0*3a);|&colon;)"
FIRST_PRIVATE_DIGIT = 0xF643
BOILERPLATE = r"(?:\*{1,2}\s*)?This and other authors['’] explanations draw from the comments to the Model Rules and from other sources\.\s*They are not comprehensive but highlight some important (?:interpretive points|aspects of the rule)\.?(?:\s*\*{1,2})?"
SECTION_MARKER_LINE = r"^[ \t]*[A-J][ \t]*(?:\n|$)"
SQUARE_LINE = r"^[ \t]*(?:■[ \t]*)+(?:\n|$)"
PERMA_URL = r"\b(https?://)\s*perma\s*\.\s*cc\s*/\s*([A-Za-z0-9]+)\s*-\s*([A-Za-z0-9]+)"
BARE_PERMA_URL = r"\bperma\s*\.\s*cc\s*/\s*([A-Za-z0-9]+)\s*-\s*([A-Za-z0-9]+)"
CONTRACTION = r"(\[[A-Za-z]\])\s+(?=(?:[a-z]'(?:re|ve|ll|d|s|t)|'(?:m|re|ve|ll|d))\b)"
SENTENCE_END = r"(?<=[a-z])\.(?=[A-Z])"
PAGE_NUMBER_LINE = r"^\s*\d{1,4}\s*$"
#: Words that lost the mark between them; fixed values.
FUSED_WORDS = {"clientlawyer": "client-lawyer", "lawyerclient": "lawyer-client", "plaintiffdefendant": "plaintiff-defendant", "threejudge": "three-judge", "newyork": "New York", "sarbanesoxley": "Sarbanes-Oxley", "wendyweikal": "Wendy Weikal", "marzanolesnevich": "Marzano-Lesnevich", "timesleader": "Times Leader", "lawbloomington": "Law Bloomington"}
#: What a normalised text must not hold; fixed patterns.
SPLIT_HYPHEN = r"(?:(?<=[A-Za-z0-9])-\s+(?=[a-z])|(?<=[A-Za-z0-9])\s+-(?=[A-Za-z0-9]))"
SPACED_LETTERS = r"(?<![A-Za-z0-9_])(?:[A-Za-z]\s+){3,}[A-Za-z](?![A-Za-z0-9_])"
BOILERPLATE_LEAD = "This and other authors' explanations draw"
KNOWN_FUSED = r"\b(?:clientlawyer|lawyerclient|plaintiffdefendant|threejudge|Aconcluding)\b"

#: Metadata that lexical search covers, in this order, and its budget in characters; fixed values.
LEXICAL_FIELDS = ["primary_case", "case_names", "section_path", "headings", "chapter_title", "context", "cross_references"]
LEXICAL_BUDGET = 2400

#: Ranking constants; fixed values.
K1, B, RRF_K = 1.5, 0.75, 10

#: Markers of case opinions, matched with case; fixed values.
CASE_MARKERS = [
    "Justice ", "Judge ", "JUSTICE ", "JUDGE ",
    "delivered the opinion", "Opinion of the Court",
    "concurring", "dissenting", "affirmed", "reversed",
    "certiorari", "Argued ", "Decided ",
]
#: Of these, the ones that count without a case heading; fixed values.
STRONG_CASE_MARKERS = ["delivered the opinion", "Opinion of the Court", "certiorari", "Argued ", "Decided "]
