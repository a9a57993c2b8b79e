"""Fixed values.  They decide results (ids, keys, scores), so they are stated as they are."""

# --- fixed values: words never used as keywords -------------------------------------------
STOPWORDS = (
    "about", "after", "again", "also", "been", "being", "from", "have", "into", "just", "more",
    "most", "over", "that", "their", "there", "they", "this", "were", "what", "when", "with",
    "will", "would", "your", "bitcoin", "crypto",
)

# --- fixed values: default sentiment lexicons ---------------------------------------------
POSITIVE_WORDS = (
    "accumulate", "adoption", "beat", "breakout", "bull", "bullish", "buy", "catalyst",
    "decentralized", "demand", "dominance", "gain", "growth", "higher", "inflow", "long", "moon",
    "outperform", "partnership", "pump", "rally", "record", "recover", "resilient", "reversal",
    "rise", "squeeze", "strong", "support", "surge", "upgrade", "uptrend", "win",
)
NEGATIVE_WORDS = (
    "ban", "bear", "bearish", "breakdown", "crackdown", "crash", "cut", "dump", "fear", "fraud",
    "hack", "higher-for-longer", "lawsuit", "liquidation", "loss", "lower", "miss", "outflow",
    "panic", "plunge", "recession", "reject", "resistance", "risk-off", "rug", "sell", "short",
    "slump", "slowdown", "uncertain", "volatility", "weak", "wipeout",
)
NEGATIONS = ("not", "never", "no", "isnt", "wasnt", "dont", "didnt", "cant", "wont")

# --- fixed values: patterns ---------------------------------------------------------------
# Letters, digits and blanks are Unicode classes where the pattern says so; the class below is
# every blank character, the next one every word character.
BLANK = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD_CHAR = r"\p{L}\p{N}_"
CASHTAG = r"\$([A-Za-z]{1,10})"
HASHTAG = rf"#([{WORD_CHAR}]+)"
URL = rf"https?://[^{BLANK})]+"
KEYWORD = r"[A-Za-z][A-Za-z0-9_]{2,}"
SENTIMENT_WORD = r"[A-Za-z][A-Za-z0-9_]{1,}"
MARKUP = r"<[^>]+>"

# --- fixed values: limits -----------------------------------------------------------------
FORUM_TEXT_CHARS = 4000
NEWS_TEXT_CHARS = 4000
PODCAST_TEXT_CHARS = 8000
FALLBACK_TITLE_CHARS = 120
POST_DIGEST_CHARS = 16
THEME_DIGEST_CHARS = 12
KEYWORD_LIMIT = 20
MAX_KEYWORDS = 8
MAX_CASHTAGS = 5
MIN_CLUSTER_SIZE = 2

# --- fixed values: scores -----------------------------------------------------------------
BULLISH_ABOVE = 0.2
BEARISH_BELOW = -0.2
HITS_FOR_FULL_SCORE = 3
SENTIMENT_SHARE, VELOCITY_SHARE, SATURATION_SHARE = 0.4, 0.35, 0.25
FREQUENCY_SHARE, DENSITY_SHARE = 0.6, 0.4
FULL_POSTS_PER_HOUR, FULL_ENGAGEMENT_PER_POST = 10.0, 500.0
VOICE_SHARE, AUTHOR_SHARE = 0.7, 0.3
FULL_SHARE_OF_VOICE, FULL_AUTHORS = 0.05, 50.0
METRIC_TOLERANCE = 1e-6

# --- fixed values: named time zones of RFC 2822 dates -------------------------------------
ZONE_OFFSETS = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}

PLATFORMS = ("twitter", "reddit", "news", "podcast")
