"""Lists, tables and thresholds whose exact content decides the results."""

# File extension -> language.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript",
    ".tsx": "typescript", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c",
    ".hpp": "cpp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".scala": "scala", ".kt": "kotlin", ".swift": "swift", ".m": "objective-c",
    ".cs": "csharp", ".proto": "protobuf", ".md": "markdown", ".txt": "text",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".html": "html",
    ".css": "css", ".scss": "scss", ".sql": "sql", ".sh": "shell", ".bash": "shell",
}

# Extensions that make a directory a service, with the language they stand for.
SERVICE_CODE_EXTENSIONS = {
    ".py": "python", ".go": "go", ".cs": "csharp",
    ".java": "java", ".js": "javascript", ".ts": "typescript",
}

# Import edge path suffix -> language family.
IMPORT_FAMILY = {
    ".py": "Python", ".go": "Go", ".js": "JavaScript", ".jsx": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".cs": "C#",
}

# File types that count as documentation.
DOC_FILE_TYPES = ["md", "markdown", "txt", "rst", "adoc"]

# README file names.
README_NAMES = ["readme.md", "readme.txt", "readme"]

# Question words.
HIGH_LEVEL_TERMS = [
    "overview", "about", "what is", "purpose", "high-level", "features",
    "how many", "architecture", "summary", "microservices", "services",
]
PROJECT_STRUCTURE_TERMS = [
    "project structure", "folder structure", "directory structure",
    "file organization", "code organization", "layout", "file structure",
]
GRAPH_TERMS = [
    "relationship", "connected", "depends on", "structure",
    "organization", "architecture", "graph", "dependency",
]
README_FIRST_TERMS = ["structure", "architecture", "overview", "about", "project", "purpose"]

# Content words per topic.
TOPIC_WORDS = {
    "microservices": ["service", "microservice", "architecture"],
    "architecture": ["architect", "structure", "diagram", "workflow", "design"],
    "project_structure": ["project", "structure", "directory", "folder", "organization", "layout"],
}

# Words of an HTTP client call.
HTTP_CLIENT_WORDS = ["http", "fetch", "axios", "request", "RestTemplate", "WebClient", "HttpClient"]

# Score multipliers, thresholds and result sizes.
BOOST_README_MD, BOOST_README, BOOST_DOCUMENTATION, BOOST_DOCS_DIR = 1.5, 1.4, 1.3, 1.2
PRIORITY_README_MD, PRIORITY_DOCS_DIR, PRIORITY_OTHER = 2.0, 1.5, 1.0
SCORE_THRESHOLD = 0.4
README_FIXED_SCORE = 0.95
HIGH_LEVEL_README_BOOST, SECONDARY_FACTOR = 1.5, 0.8
K_NORMAL, K_HIGH_LEVEL, K_SECONDARY, MIN_PRIMARY_HITS = 10, 20, 5, 3
TOPIC_LIMIT = 15

# Chunk geometry in characters.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
README_CHUNK_SIZE, README_CHUNK_OVERLAP = 1000, 100
MAX_FILE_CHARS = 1_000_000

# Ordered patterns that name the language of a snippet, first match wins.
SNIPPET_PATTERNS = [
    ("csharp", r"(public\s+class|private\s+static|protected\s+|internal\s+|namespace\s+|using\s+[\w\.]+;)"),
    ("python", r"(def\s+\w+|class\s+\w+|import\s+[\w\.]+|from\s+[\w\.]+\s+import)"),
    ("javascript", r"(const\s+\w+\s*=|let\s+\w+\s*=|function\s+\w+|class\s+\w+|import\s+.*from)"),
    ("java", r"(public\s+class|private\s+static|protected\s+|package\s+[\w\.]+|import\s+[\w\.]+)"),
    ("typescript", r"(interface\s+\w+|type\s+\w+|export\s+class)"),
    ("sql", r"(SELECT\s+.*FROM|INSERT\s+INTO|UPDATE\s+.*SET|DELETE\s+FROM)"),
]

# Patterns of a function signature anywhere in a chunk.
FUNCTION_SIGNATURES = [
    r"^\s*(public|private|protected)?\s+(static)?\s+\w+\s+\w+\s*\([^)]*\)\s*\{",
    r"^\s*def\s+\w+\s*\([^)]*\)\s*:",
    r"^\s*function\s+\w+\s*\([^)]*\)\s*\{",
    r"^\s*@\w+.*\s*\n\s*(public|private|protected)?\s+(static)?\s+\w+\s+\w+\s*\(",
    r"^\s*\w+\s*=\s*function\s*\([^)]*\)\s*\{",
    r"^\s*\w+\s*:\s*function\s*\([^)]*\)\s*\{",
    r"^\s*const\s+\w+\s*=\s*\([^)]*\)\s*=>\s*\{",
    r"^\s*\([^)]*\)\s*=>\s*\{",
]
# Patterns of a class signature anywhere in a chunk.
CLASS_SIGNATURES = [
    r"^\s*class\s+\w+(\s*\([^)]*\))?\s*:",
    r"^\s*(public|private|protected)?\s+class\s+\w+(\s+extends\s+\w+)?(\s+implements\s+\w+(?:,\s*\w+)*)?\s*\{",
    r"^\s*interface\s+\w+(\s+extends\s+\w+(?:,\s*\w+)*)?\s*\{",
    r"^\s*class\s+\w+(\s+extends\s+\w+)?(\s+implements\s+\w+(?:,\s*\w+)*)?\s*\{",
]
# Fixed values: (pattern, group) pairs that pull the name out of a signature, in order.
FUNCTION_NAME_PATTERNS = [
    (r"^\s*(public|private|protected)?\s+(static)?\s+\w+\s+(\w+)\s*\(", 3),
    (r"^\s*def\s+(\w+)\s*\(", 1),
    (r"^\s*function\s+(\w+)\s*\(", 1),
    (r"^\s*@\w+.*\s*\n\s*(public|private|protected)?\s+(static)?\s+\w+\s+(\w+)\s*\(", 3),
    (r"^\s*(\w+)\s*=\s*function\s*\(", 1),
    (r"^\s*(\w+)\s*:\s*function\s*\(", 1),
    (r"^\s*const\s+(\w+)\s*=\s*\([^)]*\)\s*=>", 1),
]
CLASS_NAME_PATTERNS = [
    (r"^\s*class\s+(\w+)", 1),
    (r"^\s*(public|private|protected)?\s+class\s+(\w+)", 2),
    (r"^\s*interface\s+(\w+)", 1),
]

# Class name endings that mark a data model.
JAVA_MODEL_SUFFIXES = ["DTO", "Entity", "Model", "Request", "Response", "Payload"]
CSHARP_MODEL_SUFFIXES = ["DTO", "Model", "Entity", "Request", "Response", "Payload", "Dto"]
