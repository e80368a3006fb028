"""Lists and patterns whose content decides results."""

# Display marks removed while reading a number.
CURRENCY_AND_SPACE = r"(?U)[£$€₹¥\s]"
TRAILING_TREND_MARKS = r"[▲▼↑↓⇗⇘⇑⇓→←⟶]+$"
SUFFIX_FACTORS = {"K": 1e3, "M": 1e6, "B": 1e9}

# Titles that are not names.
NOISE_ARROW = r"^[⇗⇘⇒⇑⇓→↑↓▲▼]"
NOISE_LEADING = r"^[$(]"
NOISE_DIGITS = r"^[\d,.\s%]+$"
NOISE_NUMBER = r"^[$(]?[\d,.]+[KMBkmbTt%]?\)?$"
NOISE_SCROLL = r"(?i)^Scroll (up|down|left|right)$"

# Visual types.
KPI_TYPES = ["Card", "Multi-row card", "KPI", "Card (new)", "Gauge"]
MULTI_VALUE_TYPES = ["Card", "Multi-row card"]
TESTABLE_TYPES = [
    "Card", "Multi-row card", "KPI",
    "Clustered bar chart", "Clustered column chart",
    "Stacked bar chart", "Stacked column chart",
    "100% stacked bar chart", "100% stacked column chart",
    "Line chart", "Area chart", "Stacked area chart",
    "Line and stacked column chart", "Line and clustered column chart",
    "Ribbon chart", "Waterfall chart", "Funnel", "Scatter chart",
    "Pie chart", "Donut chart", "Treemap",
    "Map", "Filled map", "Shape map", "Azure map",
    "Table", "Matrix", "Gauge", "Card (new)",
]
SKIPPED_TYPES = ["Text box", "img", "button", "Slicer"]
HEADING_TYPE = "Text box"
LABELLED_POINT_TYPES = [
    "Clustered bar chart", "Clustered column chart",
    "Stacked bar chart", "Stacked column chart",
    "100% stacked bar chart", "100% stacked column chart",
    "Pie chart", "Donut chart", "Treemap", "Funnel", "Waterfall chart",
    "Ribbon chart", "Line chart", "Area chart",
    "Line and stacked column chart", "Line and clustered column chart",
    "Scatter chart",
]
TABULAR_VIEW_TYPES = [
    "Table", "Matrix", "Map", "Filled map", "Azure map", "Shape map",
    "Decomposition tree", "Key influencers", "Smart narrative", "Q&A visual",
    "Paginated report visual", "Python visual", "R visual",
]

# Wording that marks a parameter control shown as a card.
PARAMETER_TITLE_WORDS = ["TopN", "BottomN", "Top N", "Bottom N", "Parameter"]
PARAMETER_TEXT_WORDS = ["TopN", "BottomN", "Field"]
FIGURE_TEXT_MARKS = ["%", "$", "Target:", "vs PM", "vs PQTD", "vs PTD"]

# Untyped visuals that are tables.
TABLE_TEXT_START = r"(?i)^Scroll (up|down|left|right)"
TABLE_HEADER_LINES = ["row selection", "rank", "agent id", "agent name"]

# Card lines that are not the figure.
CARD_DATE_LINE = (
    r"(?i)\b(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February"
    r"|March|April|May|June|July|August|September|October|November|December)\b"
)
CARD_SUB_LABEL_LINE = r"(?i) of |_name|_%|^Sum |^First |^Count |^Average |^Max |^Min "

# Chart text that is numeric.
AXIS_NUMERIC = r"^[\d.,]+$"
POINT_NUMERIC = r"(?i)^[\d,.\s%$€£¥bn]+$"

# Page indicator texts.
PAGE_COUNT_BEFORE_SECTIONS = r"(?i)of(\d+?)(?=\d+\s*-)"
PAGE_COUNT_PLAIN = r"(?i)of\s*(\d+)"

# Error banner phrases, in the order they are tried.
ERROR_PHRASES = [
    "You do not have permission",
    "This content is not available",
    "Access denied",
    "Something went wrong",
]

# Type families by keyword.
NUMERIC_TYPE_WORDS = [
    "INT", "FLOAT", "DOUBLE", "DECIMAL", "NUMERIC", "NUMBER",
    "BIGINT", "SMALLINT", "REAL", "MONEY", "CURRENCY",
]
DATE_TYPE_WORDS = ["DATE", "TIME", "TIMESTAMP", "DATETIME", "YEAR"]
TEXT_TYPE_WORDS = ["CHAR", "TEXT", "STRING", "BOOL", "ENUM", "NVAR"]

# Wording that decides an aggregate.
COUNTING_WORDS = ["count", "number of", "# of", "qty", "quantity"]
AVERAGE_WORDS = ["average", " avg", "mean", "per "]
RATIO_WORDS = ["margin", "rate", "ratio", "percent", "%", "growth"]
COMPLEX_MEASURE_WORDS = [
    "yoy", "y-o-y", "growth", "variance", "vs ", " vs", "prior year",
    "previous year", "py ", " py", "running", "cumulative", "ytd", "mtd",
]

# Step markers of a run log.
STEP_START = r"^STEP(\d)_START\|(.+)"
STEP_END = r"^STEP(\d)_END"

# Report groups of a run.
GROUP_DISCOVERY = "GROUP 1 — VISUAL DISCOVERY"
GROUP_KPI = "GROUP 2 — KPI VALIDATION"
GROUP_TABLE = "GROUP 3 — TABLE VALIDATION"
GROUP_OTHER = "GROUP 4 — OTHER DASHBOARD TESTS"

