"""Fixed values of the markup, of printed papers, and of the checks."""

# The values below are formats, patterns, word lists and thresholds that results depend on.

TOKEN = r"\d+(?:[.,]\d+)*|[a-z]+"
THOUSANDS = r"(?<=\d),(?=\d{3}\b)"
TAG = r"</?[A-Za-z!][^>]*>"

PAGE = r"^=== page (\d+) ===\s*$"
DIRECTIVE = r"^\[\[(item(?: \d+)?|head|nobreak|end|part|part head|options|/options|blank)\]\]\s*$"
KEY_LINE = r"^\[\[key\]\]\s*(.*)$"
TABLE_OPEN = r"^\[\[table (\S+)\]\]\s*$"
TABLE_CLOSE = "[[/table]]"
FIGURE = r"^\[\[figure (\S+)(?: (\S+))?\]\]\s*$"

QUESTION_START = r"(?i)^(?:\*\*)?\s*(?:(?:Q|Question|Problem|Exercise|Case)\s*\.?\s*)?(\d{1,2})\s*[.):]\s*(?=\S)"
QUESTION_WORD = r"(?i)^(?:\*\*)?\s*(Question|Problem|Exercise|Case|Q)\b"
SECTION = r"(?i)^(?:\*\*)?\s*(Section|Part|Module)\s+([A-Z0-9IVX]+)\b|^(?:\*\*)?\s*(I|II|III|IV|V|VI|VII|VIII|IX|X)\s*[.)]\s"
OPTION = r"^\(?([A-Ea-e])\s*[.)]\s*(.+)$"
INLINE_OPTIONS = r"\(([A-E])\)\s*"
OPTION_LABEL = r"^\s*\(?[A-Ea-e]\s*[.)]\s+"
INLINE_LABEL = r"\(([A-Ea-e])\)\s*"
SUBPART = r"^(\(?[a-hivx]{1,4}\)|[a-h][.)]|[ivx]{1,4}[.)]|[•\-–▪])\s"
ROMAN_SUBPART = r"^\(?[ivx]{1,4}\)\s"
PART_LABEL = r"^\(?([a-z]|[ivx]{1,4})\)\s"
MARKS = r"(?i)[\[(]\s*(\d+(?:\.\d+)?)\s*marks?\s*[\])]"
ANSWER_HINT = r"(?i)^(Ans(?:wer)?\s*[:.-])"
ANSWER_START = r"^Ans(?:wer)?\s*[:.-]"
SOLUTION_NOTE = r"(?i)other questions|remaining questions|straightforward|left (?:as an? )?exercise|not (?:covered|provided)"
KEY_ONLY = r"^\(?([A-E])\)?\.?$|^\(([A-E])\)(?=\s)"
KEY_TEXT = r"(?i)^The correct answers? (?:is|are)\s*:\s*"
PAGE_NUMBER = r"(?i)^(page\s*)?[-–—]?\s*\d+\s*[-–—]?(\s*(of|/)\s*\d+)?$"
SOLUTION_WORDS = r"(?i)(solutions?|soln?s?|answers?|answer[_ -]?key|key|ans|marking[_ -]?scheme)"
READING_WORDS = r"(?i)(notes?|reading|chapter|lecture|slides?|deck|handout|case[_ -]?note|textbook)"
SOLUTION_HEAD = r"\b(solutions?|answer key|suggested answers?)\b"
QUESTION_LINE = r"(?i)^\s*(q\.?\s*)?\d{1,2}[.)]\s+\S|\[\s*\d+\s*marks?\s*\]|\(\s*\d+\s*marks?\s*\)"
MATH_TOKEN = r"\\[()\[\]]"
DOLLAR_MATH = r"\$[^$\s][^$]*\\[a-zA-Z]+[^$]*\$"
MACRO_NAME = r"^\\[A-Za-z]+$"
DOTTED_FUNCTION = r"(?<![\w.])([A-Z]+(?:\.[A-Z0-9]+)+)\("
TICK_LABEL = r"[\d.,:%$-]{1,6}"
SIGNED_NUMBER = r"[-\u2212]?\d[\d,]*(?:\.\d+)?"
BOLD_FONT = r"(?i)bold|black|heavy|semibold|demi|,b$"
ITALIC_FONT = r"(?i)italic|oblique|,i$"

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "heic")
OFFICE_SUFFIXES = ("pptx", "ppt", "docx", "doc", "odt", "odp", "rtf")
SHEET_SUFFIXES = ("xlsx", "xlsm", "xls")
#: Sections that may be chosen, and their other names.
SECTION_NAMES = {
    "concepts": ("concepts", "concept", "notes", "theory"),
    "questions": ("questions", "question", "quiz", "bank", "mcq", "mcqs"),
    "papers": ("papers", "paper", "pyq", "pyqs", "past", "past-papers"),
    "reference": ("reference", "guide", "cheatsheet", "cheat-sheet", "quick-reference"),
}
BLOCK_TYPES = ("h", "p", "list", "steps", "defs", "table", "box", "fig", "pre", "flow", "cpm", "chart", "gantt", "ex")
DRAWN_TYPES = ("fig", "flow", "chart", "gantt", "cpm")
DIFFICULTIES = ("E", "M", "H")

PRECISION_ERROR, PRECISION_RISK = 0.90, 0.995
CALC_TOLERANCE, CALC_FLOOR = 0.005, 1e-9
LOW_CONFIDENCE, HANDWRITING_MEAN, HANDWRITING_LOW = 80, 72, 0.30
TOP_BAND, BOTTOM_BAND = 0.09, 0.92
RISK_WEIGHTS = {
    "error": 10.0,
    "OCR corrected": 4.0,
    "handwritten source": 4.0,
    "scanned source": 3.0,
    "official solution from a scan": 3.0,
    "hand-made item (no source span)": 3.0,
    "table": 2.0,
    "figure": 1.0,
    "MCQ": 0.5,
}
TEXT_MATCH_WEIGHT = 3.0
