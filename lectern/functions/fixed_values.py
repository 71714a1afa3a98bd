"""Constants, word lists, lookup tables and patterns that results depend on."""

# --- retrieval: fixed values -------------------------------------------------
TOKEN_PATTERN = "[a-z0-9]+(?:[-.][a-z0-9]+)*"
SEARCH_STOPWORDS = (
    "a an the of in on at to for and or is are was were be been it its this that these those as "
    "by with from what which does do how why when"
).split()
# (suffix, shortest token it applies to, replacement)
STEM_SUFFIXES = [("ies", 5, "y"), ("es", 5, ""), ("s", 4, ""), ("ing", 6, ""), ("ed", 5, "")]
STEM_MIN_TOKEN = 4
STEM_MIN_BASE = 3

BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60
DENSE_TOP_K = 50
SPARSE_TOP_K = 50
FUSED_TOP_K = 30
FINAL_TOP_K = 6
REFUSAL_THRESHOLD = 0.327
TITLE_BOOST = 0.30
CONCEPT_WEIGHT = 2.0
SECONDARY_WEIGHT = 1.0

RERANK_MAX_TERMS = 8
RERANK_COVERAGE = 0.70
RERANK_PROXIMITY = 0.30
RERANK_PHRASE_BONUS = 0.15
RERANK_SINGLE_PROXIMITY = 0.5
FRAMING_WORDS = (
    "still support supports supported claim claims claimed say says said saying tell tells explain "
    "explains describe describes discuss discusses according actually really just also more most "
    "such using use uses used given give gives get gets make makes made would could should may "
    "might can will there here about textbook chapter course reading lecture slide slides material "
    "materials data show shows shown mean means happen happens think know need want"
).split()

# --- question intent and decomposition: fixed values --------------------------
INTENT_ADMINISTRATIVE = (
    r"\b(my grade|what grade did i|office (?:phone|number|hours)|"
    r"will be on the (?:final|exam)|professor'?s? (?:phone|email|number))\b"
)
INTENT_TASK = (
    r"\b(translate|prove that|write (?:my|the solution|an essay)|solve problem set|"
    r"do my homework|recommend a|what should i buy|install)\b"
)
INTENT_OFFICE_HOLDER = r"\bwho is the (?:current|present)\b"
INTENT_TEMPORAL = (
    r"\b(current|currently|today|todays|right now|at present|latest|most recent|"
    r"this (?:week|month|year)|last (?:week|month|quarter|year))\b"
)
INTENT_QUANTITATIVE = (
    r"\b(?:the\s+)?(?:trend|trends)\s+in\b"
    r"|\bcorrelation\s+between\b"
    r"|\brate\s+of\s+(?:growth|change)\s+(?:of|in)\b"
    r"|\bgrowth\s+rate\s+of\b"
    r"|\bwhat\s+percentage\s+of\b"
    r"|\bstatistically\s+significant\b"
    r"|\b(?:plot|chart|graph)\s+(?:the|a)\b"
    r"|\bshow\s+me\s+the\s+(?:trend|change|growth|distribution)\b"
)

# marks come last and one at a time, so that a line that begins with "and how" is split before "how"
CLAUSE_SPLIT = (
    r"\s+and\s+(?=give|explain|show|tell|describe|list|walk|define|how\b|why\b|what\b|when\b|where\b)"
    r"|,\s+(?=(?:how|why|what|give|explain|define|show|tell)\b)"
    r"|[?;\n]"
)
LEAD_FRAMING = (
    r"^\s*(?:what(?:'s| is| are| does| do)?|who(?:'s| is| are)?|"
    r"how (?:does|do|is|are|can|would|might)?|why (?:does|do|is|are)?|"
    r"when (?:does|do|is|are)?|where (?:does|do|is|are)?|"
    r"define|defines|explain|describe|discuss|summari[sz]e|"
    r"tell me about|give me|show me|walk me through|can you|please|"
    r"i want to know about|i'd like to know about)\b[\s:,]*"
)
LEAD_ARTICLE = r"^\s*(?:the|a|an|this|that|these|those|its|it|it's)\b\s*"
LEAD_EXAMPLE_OF = r"^\s*(?:real[\s-]?world\s+)?(?:examples?|instances?)\s+of\s+"
TRAIL_FILLER = (
    r"\s*(?:and explain it(?: to me)?|and explain|to me|for me|please|"
    r"in (?:simple|plain) (?:terms|english)|work|works|mean|means|actually mean|really mean)\s*$"
)
WANTS_EXAMPLE = r"\b(example|examples|instance|for instance|e\.g\.|such as|illustrat\w*|concrete)\b"
WANTS_APPLICATION = (
    r"\b(real[\s-]?world|in practice|in the real world|applicat\w*|apply|applies|"
    r"applied|used in|use case|matter\w* in|play\w* (?:in|into))\b"
)
CONCEPT_MAX_WORDS = 8

# --- grounding and answers: fixed values --------------------------------------
GROUNDING_STOPWORDS = (
    "a an the of in on at to for and or is are was were be been it its this that these those as "
    "by with from which not but than then so only also"
).split()
GROUNDING_MIN_SENTENCE = 25
GROUNDING_MIN_TERM = 3
GROUNDING_COVERAGE = 0.8
ANSWER_STOPWORDS = (
    "a an the of in on at to for and or is are was were be it its this that these those as by with "
    "from what which does do how why when about according explain describe"
).split()
ANSWER_MIN_TERM = 2
ANSWER_SENTENCE_MIN = 20
ANSWER_SENTENCE_MAX = 400
ANSWER_MAX_SENTENCES = 4
ANSWER_RANK_DECAY = 0.6
ANSWER_OVERLAP_WEIGHT = 0.25
REFUSAL_PHRASES = [
    "i don't have access",
    "i do not have access",
    "i cannot",
    "i can't",
    "not able to",
    "don't have information",
    "no information about",
]
CITATION_BLOCK = r"\[([^\]]+)\]"
CITATION_LABEL = r"[A-Za-z0-9_-]{2,20},\s*(?:Ch\s*\d+,\s*)?pp?\.\s*\d+(?:[–-]\d+)?"

# --- page text and blocks: fixed values ----------------------------------------
MARKER_CHAPTER = r"<!--\s*chapter:\s*(\d+)\s*\|\s*title:\s*(.+?)\s*-->"
MARKER_SECTION = r"<!--\s*section:\s*(.+?)\s*-->"
MARKER_PAGE = r"<!--\s*page:\s*(\d+)\s*-->"
HEADING_CHAPTER = r"^\s*chapter\s+(\d{1,2})\b[:.\s]*(.*)$"
HEADING_CHAPTER_ROMAN = r"^\s*chapter\s+([IVXLC]{1,7})\b[:.\s]*(.*)$"
HEADING_SECTION = r"^\s*(\d{1,2}\.\d{1,2})\s+(.+)$"
OUTLINE_CHAPTER = r"^\s*chapter\s+(\d{1,2}|[IVXLC]{1,7})\b[:.\s]*(.*)$"
OUTLINE_PAGE_LABEL = r"^\s*p+\.?\s*(\d{1,5})\s*$"
HEADING_MAX_LINE = 90
HEADING_MAX_TITLE = 60
ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
RUNNING_HEADER_LINES = 2
RUNNING_HEADER_MAX = 60
RUNNING_HEADER_MIN_LETTERS = 3
PAGE_NUMBER_MAX_DIGITS = 4
WORDS_PER_PAGE = 500
EMPTY_PAGE_CHARS = 40
OCR_SLOW_RATIO = 0.25
EMPTY_WARN_RATIO = 0.5
TOKENS_PER_WORD = 1.3
CHILD_TOKENS = 400
PARENT_TOKENS = 1200
CHILD_OVERLAP = 64
CHAPTER_OPENING_CHARS = 900
SAMPLE_PER_FILE = 20
SAMPLE_PER_BATCH = 40

BLOCK_DEFINITION = r"^\s*(definition|theorem|lemma|proposition|corollary)\b"
BLOCK_TABLE_LINE = r"^\s*\|.*\|\s*$|^\s*\S+(?:\t| {3,})\S+"
BLOCK_EQUATION = r"^\s*(?:\$\$.*?\$\$|\\\[.*?\\\]|[A-Za-z]\s*[=<>]\s*[^.]{0,120})\s*$"
BLOCK_EQUATION_HINT = r"[=×·∑∫∂α-ωΑ-Ω]|\\frac|\\sum|\^|_\{"
EQUATION_OPERATORS = "=<>+-*/^"
EQUATION_NUMBER = r"^\(\d{1,2}\.\d{1,3}\)$|^\(\d{1,3}\)$"
EQUATION_RELATION = r"[=≤≥<>∑∫≡≠→]|\\frac|\\sum"
EQUATION_CONTINUATION = r"^[A-Za-z0-9_{}\\.^+−*/=<>≤≥()\s-]+$"
EQUATION_CONTINUATION_MAX = 32

# --- files and courses: fixed values -------------------------------------------
CORPUS_SUFFIXES = ["pdf", "docx", "md", "markdown", "txt"]
SOURCE_TYPE_KEYWORDS = [
    ("bbplus", ["bbplus"]),
    ("slides", ["slide", "lecture", "deck", "ppt"]),
    ("notes", ["note", "handout"]),
    ("textbook", ["text", "book", "edition", "principles", "intro"]),
]
FAILURE_HINTS = [
    (
        "cannot open empty file",
        "the file is empty (0 bytes) -- the upload may have been interrupted",
    ),
    (
        "failed to open file",
        "the file is not a readable PDF. It may be corrupt, truncated, or renamed from another format",
    ),
    ("no objects found", "the PDF structure is damaged and cannot be opened"),
    ("password", "the file is password-protected. Remove the password and re-upload"),
    ("encrypted", "the file is encrypted. Remove the protection and re-upload"),
    (
        "unsupported file type",
        "that file type is not supported. Upload PDF, DOCX, Markdown or plain text",
    ),
]
DATA_MARKERS = [
    "inflation", "unemployment", "gdp", "gross domestic product", "interest rate",
    "monetary policy", "fiscal policy", "price index", "consumer price",
    "exchange rate", "recession", "business cycle", "econometric", "regression",
    "time series", "elasticity", "demand curve", "supply curve", "equilibrium price",
    "marginal cost", "marginal revenue", "consumer surplus", "market equilibrium",
    "utility maximization", "budget constraint", "opportunity cost", "monopoly",
    "oligopoly", "labour supply", "labor supply", "capital market", "asset pricing",
    "portfolio", "interest", "wage", "productivity", "output per worker",
]
NON_DATA_MARKERS = [
    "narrator", "protagonist", "stanza", "metaphor", "prose", "novel", "poem",
    "rhetoric", "close reading", "literary", "author", "chapter of the novel",
    "excavation", "stratigraphy", "artefact", "artifact", "archaeological",
    "ethnography", "kinship", "fieldwork", "positionality", "colonial",
    "register", "cache", "instruction set", "assembly", "compiler", "pipeline",
    "operating system", "byte", "pointer", "processor", "memory hierarchy",
    "algorithm", "data structure", "runtime complexity",
]
CAPABILITY_RATIO = 1.6
CAPABILITY_MIN_CHARS = 4000
CAPABILITY_SYLLABUS_CHARS = 3000
CAPABILITY_SAMPLE_CHARS = 12000

# --- references, dates and schedule rows: fixed values --------------------------
CHAPTER_MENTIONS = [
    r"\bch(?:apter|apt|\.)?\s*:?\s*(\d{1,2})\b",
    r"\b(\d{1,2})\.\d{1,2}\s*[-–]\s*\d{1,2}\.\d{1,2}\b",
    r"\b(\d{1,2})\.\d{1,2}\b",
]
SECTION_RANGE = r"\b(\d{1,2})\.(\d{1,2})\s*[-–]\s*(?:\d{1,2}\.)?(\d{1,2})\b"
CHAPTER_REF_IN_TITLE = r"\(\s*ch\.?\s*\d+\s*\)|\bch\.?\s*\d+\b"
WEEKDAY_INDEX = {
    "mon": 0, "monday": 0, "tue": 1, "tues": 1, "tuesday": 1, "wed": 2, "wednesday": 2,
    "thu": 3, "thur": 3, "thurs": 3, "thursday": 3, "fri": 4, "friday": 4,
    "sat": 5, "saturday": 5, "sun": 6, "sunday": 6,
}
WEEK_REF = r"\bweek\s+(\d{1,2})\b"
ISO_DATE = r"\b(\d{4})-(\d{2})-(\d{2})\b"
US_DATE = r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b"
MONTH_DAY = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})\b"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
HOLIDAY = r"\b(no class|holiday|break|recess|reading day|thanksgiving|spring break)\b"
EXAM = r"\b(midterm|final exam|final|quiz|exam)\b"
DUE = r"\b(due|deadline|submit|problem set|ps\s*\d|paper|essay)\b"
HEADER_LINE = r"^\s*(term|semester|instructor|meets?|office|email|grading|prereq)\b"
TERM_START_LINE = r"\b(?:term|semester)\s+(?:starts|start|begins)\s*:?\s*(\S+)"
TERM_END_LINE = r"\b(?:term|semester)\s+(?:ends|end)\s*:?\s*(\S+)"
MEETS_LINE = r"\b(?:meets?|meeting days?)\s*:?\s*([A-Za-z,/ ]+)"
COURSE_CODE_LINE = r"^([A-Z]{2,5}\s*\d{3})\s*[:\-]?\s*(.+)$"
DAY_WORDS = {
    "monday": "MO", "mon": "MO", "m": "MO",
    "tuesday": "TU", "tues": "TU", "tue": "TU", "t": "TU",
    "wednesday": "WE", "wed": "WE", "w": "WE",
    "thursday": "TH", "thurs": "TH", "thu": "TH", "th": "TH", "r": "TH",
    "friday": "FR", "fri": "FR", "f": "FR",
    "saturday": "SA", "sat": "SA",
    "sunday": "SU", "sun": "SU",
}
DAY_LETTERS = {"M": "MO", "T": "TU", "W": "WE", "R": "TH", "F": "FR", "U": "SU", "A": "SA"}
WEEKDAY_CODES = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
ASSESSMENT_KINDS = [
    "exam", "quiz", "homework", "problem_set", "paper", "project", "reading_response",
    "presentation", "midterm", "final",
]
EXAM_KINDS = ["exam", "quiz", "midterm", "final"]
LINK_FLOOR = 0.34
LINK_NUMBER_BONUS = 0.08
LINK_EMBEDDING_WEIGHT = 1.5
LINK_AMBIGUITY = 0.02
TERM_DEFAULT_DAYS = 120
SYLLABUS_NAME = r"syllabus|syll|course[ _-]*outline"
SYLLABUS_STRUCTURE = (
    r"\b(course description|course objectives|grading policy|grading scale|assessment weights|"
    r"course outline|course requirements)\b"
)
SYLLABUS_CODE = r"\b([A-Z]{2,8})\s*[- ]?(\d{1,4})\b"
ACADEMIC_PREFIXES = [
    "CS", "CSC", "CSCI", "ECON", "MATH", "MAT", "CALC", "ENG", "ENGL", "ART", "BIO", "CHEM",
    "PHYS", "PSY", "STAT", "HIST", "POLI", "BUS", "ACCT",
]

# --- dashboards and calendar: fixed values ---------------------------------------
ENGAGEMENT_PS_WEIGHT = 2.0
ENGAGEMENT_EXPORT_WEIGHT = 1.5
ENGAGEMENT_SATURATION = 10.0
READINESS_ENGAGED = 0.6
PROGRESS_ENGAGED = 0.3
PLAN_MAX_DAYS = 10
UPCOMING_DAYS = 21
UPCOMING_ROWS = 8
RUN_LOG_ROWS = 100
ALARM_DAYS = [7, 3, 1]
TASK_KINDS = [
    "deadline", "due", "exam", "project", "research", "meeting", "custom", "homework",
    "problem_set", "paper", "quiz", "reading_response", "presentation", "midterm", "final",
    "concept",
]
# (name, month, rule): a day of the month, or (weekday Mon=0, nth; -1 is the last)
HOLIDAYS = [
    ("New Year's Day", 1, 1),
    ("Martin Luther King Jr. Day", 1, (0, 3)),
    ("Presidents' Day", 2, (0, 3)),
    ("Memorial Day", 5, (0, -1)),
    ("Juneteenth", 6, 19),
    ("Independence Day", 7, 4),
    ("Labor Day", 9, (0, 1)),
    ("Indigenous Peoples' Day", 10, (0, 2)),
    ("Veterans Day", 11, 11),
    ("Thanksgiving", 11, (3, 4)),
    ("Christmas Day", 12, 25),
]
THANKSGIVING_BREAK = "Thanksgiving break"

# --- practice and grades: fixed values ---------------------------------------------
PROBLEM_TYPES = [
    "numeric", "symbolic", "symbolic_derivation", "proof", "short_answer", "multiple_choice",
    "code", "essay", "essay_prompt",
]
PROBLEM_TYPE_ALIASES = {
    "symbolic derivation": "symbolic_derivation",
    "essay prompt": "essay_prompt",
    "short answer": "short_answer",
    "multiple choice": "multiple_choice",
}
PROBLEM_CONFIDENCE_FLOOR = 0.55
PRACTICE_LINK_FLOOR = 0.30
GENERIC_CHAPTER_TERMS = (
    "curve curves line lines graph graphs function functions equation equations set sets problem "
    "problems example examples"
)
ANSWER_PAIR = r"([A-Za-z][A-Za-z0-9_]*)\s*=\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
GRADE_REL_TOL = 1e-3
GRADE_ABS_TOL = 1e-5
VERIFY_REL_TOL = 1e-3
HELP_ARITHMETIC = r"\d+(?:\.\d+)?\s*(?:\*|×|/|\+|−|-)\s*\d+|=\s*-?\d"
HELP_CONCLUSION = r"\b(?:the answer is|conclude that|therefore.*\b(?:true|false|equal))\b"
WEIGHT_TOLERANCE = 1e-5
