"""Fixed values that results depend on; they must equal those of the engine whose results this one matches."""

# fixed values: sizes and budgets
CHUNK_CHARS = 1500
CHARS_PER_TOKEN = 3.75
SOFT_MINIMUM = 0.75
MAX_CHUNKS = 2000
MAX_FILE_BYTES = 2_000_000
BUDGET_DEFAULT, BUDGET_MIN, BUDGET_MAX = 3000, 100, 16000
HEADER_RESERVE_TOKENS = 120
ASK_CAP = 32
MAX_K = 200
RRF_K = 60
FINE_BUDGET = 8000
BLOCK_TOKENS = 4096
SHARD_TOKENS = 250_000
MAX_SITES, MAX_SYMBOLS = 12, 6
GIST_TOKENS = 32
OMIT_STEPS = (6, 3, 1, 0)
SIZE_WIDTH = 7

# fixed values: paths left out by default
DEFAULT_EXCLUDES = (
    "**/.git/**", "**/.hg/**", "**/.svn/**", "**/node_modules/**",
    "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/env/**",
    "**/.mypy_cache/**", "**/.pytest_cache/**", "**/.ruff_cache/**",
    "**/dist/**", "**/build/**", "**/target/**", "**/vendor/**",
    "**/.next/**", "**/.nuxt/**", "**/coverage/**", "**/.tox/**",
    "**/*.min.js", "**/*.min.css", "**/*.map", "**/*.lock",
    "**/package-lock.json", "**/yarn.lock", "**/poetry.lock",
    "**/Cargo.lock", "**/pnpm-lock.yaml", "**/*.ipynb_checkpoints/**",
)

# fixed values: suffixes of binary files
BINARY_EXT = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg",
    ".pdf", ".zip", ".gz", ".tar", ".bz2", ".xz", ".7z", ".rar",
    ".so", ".dylib", ".dll", ".a", ".o", ".pyc", ".pyo", ".class",
    ".jar", ".wasm", ".bin", ".dat", ".db", ".sqlite", ".sqlite3",
    ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp3", ".mp4", ".mov",
    ".avi", ".wav", ".flac", ".parquet", ".npy", ".npz", ".pt", ".pth",
    ".onnx", ".safetensors", ".h5", ".pkl",
)

# fixed values: sensitive names and globs
SENSITIVE_NAMES = (".env", ".envrc", ".netrc", ".npmrc", ".pypirc", ".dockercfg", ".git-credentials", ".htpasswd", "id_rsa", "id_ed25519", "credentials")
SENSITIVE_GLOBS = ("**/.env", "**/.env.*", "**/*.pem", "**/*.key", "**/*.p12", "**/*.pfx", "**/*_rsa", "**/*.keystore", "**/.aws/**", "**/.ssh/**")

# fixed values: suffixes, folders and names that hold no program source
NON_SOURCE_EXT = (
    ".rst", ".md", ".markdown", ".adoc", ".txt", ".rtf", ".tex", ".pod",
    ".csv", ".tsv", ".json", ".jsonl", ".ndjson", ".xml", ".yaml", ".yml",
    ".toml", ".ini", ".cfg", ".conf", ".properties", ".sql", ".dta", ".arff",
    ".ipynb", ".geojson", ".svg",
    ".lock", ".sum", ".mod", ".log", ".patch", ".diff", ".map",
    ".html", ".htm", ".xhtml", ".css", ".scss", ".less",
    ".xls", ".xlsx", ".xlsm", ".xlsb", ".ods", ".sas7bdat", ".sav",
    ".parquet", ".feather", ".orc", ".msgpack", ".odt", ".xsl", ".xslt",
    ".h5", ".hdf5", ".pickle", ".pkl", ".npy", ".npz",
    ".gz", ".bz2", ".xz", ".zip", ".tar", ".7z",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".woff", ".woff2", ".ttf",
    ".so", ".dylib", ".dll", ".o", ".obj", ".a", ".lib", ".exe", ".class",
    ".pyc", ".pyd", ".wasm",
)
NON_SOURCE_DIR = r"(^|/)(doc|docs|benchmarks?|examples?|scripts|ci)/"
GENERATED = r"(^|/)(vendor|node_modules|third_party|dist|build)/|\.min\.[a-z]+$|\.generated\.[a-z]+$|_pb2?\.[a-z]+$"
TEST_PATH = r"(^|/)(tests?|testing)/|(^|/)test_[^/]*$|_test\.[a-z]+$"

# fixed values: line patterns
BOUNDARY = r"^(?:def |class |async def |function |const |let |var |export |import |from |type |struct |impl |enum |trait |interface |public |private |protected |func |fn |package |module |@|#\[|///|/\*\*)"
SYMBOL = r"^(\s*)(?:export\s+)?(?:async\s+)?(?:def|class|function|func|fn|impl|struct|interface|type)\s+([A-Za-z_][\w.]*)"
REFERENCE = r"\.([a-z][a-zA-Z0-9_]{4,})\b(?!\s*\()"
REFERENCE_SKIP = ("start_line", "end_line")
DEF_HEAD = r"^[ \t]*(?:(?:export|default|public|private|protected|internal|static|final|abstract|open|override|inline|async|pub|declare)\b[ \t]+)*(?:def|class|function|func|fn|impl|struct|interface|type|trait|enum)\b[ \t]+([A-Za-z_]\w*)[ \t]*"
DEF_TAIL = r"(?=[(<{\[:=;]|$|\b(?:struct|interface|enum|for|extends|implements|where)\b)"
DEF_TYPED = r"^[ \t]*(?:cdef|cpdef)[ \t]+[\w\s\*\[\]]*?\b([A-Za-z_]\w*)[ \t]*\("
STOP_NAMES = ("main", "run", "get", "set", "call", "test", "setup", "next", "close", "read", "write", "copy", "update", "keys", "values", "items", "name", "value", "data", "self")
LITERAL = r"""^\s*([A-Za-z_]\w*)\s*=\s*(["'].*?["']|\d+|True|False|None)\s*,?\s*$"""
