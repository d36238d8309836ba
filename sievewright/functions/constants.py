"""Fixed values that results depend on: word lists, patterns, character sets and limits."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values ---------------------------------------------------------------------------------------------------------

GAMBLING_ADULT = [
    "slot gacor", "maxwin", "togel", "zeus slot", "scatter hitam",
    "situs slot", "rtp slot", "bandar togel", "judi online",
    "bokep", "porn", "pinjol ilegal", "obat pembesar",
]

SUSPICIOUS_DOMAINS = [".xyz", ".top", ".click", ".gacor", ".live", ".bet"]

PROFANITY = [
    "anjing", "bangsat", "kontol", "memek", "ngentot", "goblok", "tolol",
    "bajingan", "asu", "babi", "jancok", "kampret", "brengsek", "sialan",
    "fuck", "shit", "bitch", "asshole", "cunt", "bastard", "dick",
]

MARKETING = [
    "download", "daftar", "member", "beli", "jual", "online", "gratis",
    "terbaik", "promo", "diskon", "login", "akun", "aplikasi", "situs",
    "website", "bonus", "hadiah", "klik", "kunjungi", "pendaftaran",
    "mendaftar", "transfer", "pembayaran", "deposit", "withdraw",
]

EDUCATIONAL = [
    "penelitian", "ilmiah", "eksperimen", "teori", "rumus", "universitas",
    "profesor", "jurnal", "sains", "matematika", "fisika", "biologi",
    "kimia", "sejarah", "analisis", "metode", "hipotesis", "data",
    "research", "scientific", "theory", "university", "journal",
    "science", "mathematics", "physics", "biology", "chemistry", "history",
    "analysis", "method", "hypothesis",
]

BLOCK_TAGS = ["script", "style", "noscript", "iframe", "svg"]

#: In the order in which they are replaced.
ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&hellip;", "..."),
    ("&mdash;", "—"), ("&ndash;", "-"), ("&rsquo;", "'"), ("&lsquo;", "'"),
    ("&rdquo;", '"'), ("&ldquo;", '"'),
]

ALLOWED_SYMBOLS = ".,!?;:'\"-()[]{}/%&@#" + "+=<>*^~°µ±÷×√∑∏∫πθ$€£¥_|\\"

BOILERPLATE = [
    r"\b(beranda|home)\s*[\|/>]\s*(tentang|about)",
    r"\bbaca\s+juga\s*:",
    r"\b(cookie|kebijakan\s+privasi)\s+(kami|ini)\s+(menggunakan|digunakan)",
    r"\b(share|bagikan)\s*:\s*(facebook|twitter|whatsapp)",
    r"\ball\s+rights?\s+reserved\b",
    r"\bhak\s+cipta\s+dilindungi\b",
    r"\bsubscribe\s+(to\s+)?(our\s+)?newsletter\b",
    r"\bberlangganan\s+newsletter\b",
    r"^\s*(menu|navigasi)\s*[:|]",
]

ALLOWED_LANGUAGES = ["id", "en"]
LANGUAGE_SAMPLES, LANGUAGE_SAMPLE, LANGUAGE_LEAST_SAMPLE, LANGUAGE_LEAST = [0.15, 0.5, 0.85], 2000, 200, 800

CHAT_TAGS = ["<pengguna>", "</pengguna>", "<asisten>", "</asisten>"]

#: name: target in tokens, text field; in order of priority.
SOURCE_CATALOG = [
    ("wikipedia_id", 3_000_000_000, "text"), ("wikipedia_en", 2_000_000_000, "text"), ("fineweb_edu", 30_000_000_000, "text"),
    ("cosmopedia_v2", 10_000_000_000, "text"), ("openwebmath", 6_000_000_000, "text"), ("algebraic_stack", 4_000_000_000, "text"),
    ("starcoder_python", 8_000_000_000, "content"), ("starcoder_javascript", 6_000_000_000, "content"), ("starcoder_java", 6_000_000_000, "content"),
    ("starcoder_go", 5_000_000_000, "content"), ("starcoder_cpp", 5_000_000_000, "content"), ("culturax_id", 15_000_000_000, "text"),
]

#: Presets: name, layers, hidden size, heads, key-value heads, vocabulary.
PRESETS = [
    ("tiny_130m", 16, 768, 12, 4, 32000),
    ("prod_300m", 24, 1024, 16, 4, 32000),
    ("prod_500m", 32, 1152, 18, 6, 32000),
    ("prod_1b", 38, 1536, 24, 8, 64000),
]

#: Corpus of a tokenizer: rows, least length, characters kept of each, share of all characters reached; in order.
CORPUS_CAPS = [(150_000, 50, None, 0.25), (100_000, 50, 2000, 0.45), (200_000, 100, 1000, 0.75), (150_000, 50, 1500, 1.0)]
CORPUS_CHARS = 400_000_000

#: Minimum-hash: words of a shingle, hashes, slots that agree at least.
SHINGLE_WORDS, HASHES, NEAR_SLOTS = 5, 32, 28

BUFFER_DOCS, CHUNK_TOKENS, SHARD_CHUNKS = 5000, 10_000_000, 40

# ----------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """Limits of the gates. A document is rejected beyond a maximum, not at it."""

    max_markup_density: float = 0.15
    min_words: int = 500
    max_words: int = 10_000
    max_symbol_ratio: float = 0.30
    symbol_run: int = 5
    max_boilerplate: float = 3.0
    max_links: int = 10
    dominant_min_words: int = 10
    max_profanity: float = 3.0
    max_marketing: float = 15.0
    #: off, column (a language column), detect (a function that the caller gives), or a column of votes computed elsewhere.
    language: str = "off"
    language_column: str = "lang"
