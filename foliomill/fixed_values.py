"""Everything a result depends on to the letter.

These lists, limits, patterns and text formats define the corpus format; changing one changes the
output.  They are stated here once, as plain text, and nowhere else.
"""

# --- fixed values: limits -------------------------------------------------------------------------
SPLIT_LIMIT = 450_000
MIN_LENGTH = 50
PRECISE_MIN_CHARS = 100
FALLBACK_MIN_CHARS = 50
CHUNK_MAX_CHARS = 12_000
SUMMARY_INPUT_CHARS = 3000
SUMMARY_MAX_WORDS = 70
SUMMARY_KEEP_WORDS = 60
FETCH_ATTEMPTS = 3
CACHE_TTL_SECONDS = 86400
MISSING_POSITION = 9999
EST_CHARS_PER_PAGE = 5000
EST_SECONDS_PER_PAGE = 1.5
PREVIEW_URLS = 20
CONCURRENCY = 5

# --- fixed values: URL rules ----------------------------------------------------------------------
SKIP_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp",
    ".pdf", ".zip", ".gz", ".tar", ".exe", ".dmg",
    ".mp4", ".mp3", ".avi", ".mov",
    ".css", ".js", ".json", ".xml",
]
IGNORE_URL_PATTERNS = [
    r"/search\.html", r"/genindex\.html", r"/download\.html",
    r"\?print=1", r"/(tag|category|author)/",
    r"/page/\d+/?$", r"/page=\d+",
]
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/"]

# --- fixed values: page furniture -----------------------------------------------------------------
REGION_SELECTORS = [
    "main", "article", "[role='main']", "div.main-content", "div#content", "div.content",
]
NOISE_TAGS = ["nav", "header", "footer", "aside", "script", "style", "noscript"]
NOISE_WORDS = [
    "pagination", "sidebar", "edit-on-github", "next-page", "prev-page",
    "breadcrumb", "cookie-banner", "ad", "advertisement", "banner",
    "social-share", "related-posts", "comments", "feedback",
    "table-of-contents", "toc", "menu", "nav", "navigation",
    "site-footer", "site-header", "announce", "announcement",
]
TITLE_SEPARATORS = [" | ", " - ", " — ", " :: "]
UNTITLED = "Untitled"

# --- fixed values: output formats -----------------------------------------------------------------
FORMATS = ["md", "txt", "jsonl"]
DEFAULT_SLUG = "default_scrape"
TOC_HEADING = "# 📑 MỤC LỤC"
TOC_COUNT = "Tổng số trang: **{}**"
SUMMARY_QUOTE = "> **Tóm tắt:** {}"
SUMMARY_PROMPT = "Tiêu đề: {}\n\nNội dung:\n{}"
RULE = "=" * 60

# --- fixed values: reasons ------------------------------------------------------------------------
REASON_FORBIDDEN = "403 Forbidden"
REASON_NOT_FOUND = "404 Not Found"
REASON_TIMEOUT = "Timeout"
REASON_EXHAUSTED = "Max retries exceeded"
REASON_SHORT = "Nội dung quá ngắn hoặc rỗng (< {} chars)"
REASON_DUPLICATE = "Duplicate content"

# --- HTML vocabulary (HTML standard) --------------------------------------------------------------
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
]
OPTIONAL_END_TAGS = [
    "p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot",
]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCK_TAGS = [
    "html", "head", "title", "body", "p", "div", "section", "article", "main", "nav", "header",
    "footer", "aside", "figure", "figcaption", "dl", "dt", "dd", "form", "fieldset", "address",
    "details", "summary", "center", "noscript", "caption",
]

# --- character classes ----------------------------------------------------------------------------
# Line breaks and white space as Unicode-aware text tools see them; Java's \s is ASCII only.
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
INLINE_SPACES = (
    "\t\x1f \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
)
WHITE_SPACE = LINE_BREAKS + INLINE_SPACES
# The same two sets as regex class bodies, in the syntax Java and RE2 share.
LINE_BREAK_CLASS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
INLINE_SPACE_CLASS = r"\t\x1f \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
WHITE_SPACE_CLASS = LINE_BREAK_CLASS + INLINE_SPACE_CLASS
# Unicode noncharacters that stand for "keep this space / newline / tab" and for "be at the start of a
# line" while a page is assembled.
KEEP_SPACE, KEEP_NEWLINE, KEEP_TAB = "\ufdd0", "\ufdd1", "\ufdd2"
LINE_START = "\ufdd3"
# NBSP becomes a space; zero-width and non-printing characters are removed.
NOISE_CHAR_CLASS = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}"

# --- tokeniser ------------------------------------------------------------------------------------
# Comment | whole script | whole style | tag with quoted attributes | other markup | text | stray "<".
# Outside quotes a tag ends at the next "<" or ">", so a truncated tag cannot swallow what follows, and
# no two alternatives compete for the same characters, so matching is linear in the page.  The
# possessive loop (*+) keeps Java from recursing once per attribute; as nothing is ambiguous, the plain
# loop means the same to engines without possessive quantifiers.
TOKEN_PATTERN = (
    r"(?is)<!--.*?-->"
    r"|<script\b.*?</script\s*>"
    r"|<style\b.*?</style\s*>"
    r"""|</?[a-z][^<>=]*(?:=\s*(?:"[^"]*"|'[^']*'|[^"'<>=\s])[^<>=]*)*+>"""
    r"|</?[a-z!?/][^<>]*>"
    r"|<[!?][^<>]*>"
    r"|[^<]+"
    r"|<"
)
