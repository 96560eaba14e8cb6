"""Fixed value domains: ordinals, file routing, rule metadata and confidence classes."""

from __future__ import annotations

#: Ordinal domains; a lower rank is stronger. CRITICAL comes from dependency advisories.
SEVERITIES = {"CRITICAL": -1, "HIGH": 0, "MEDIUM": 1, "LOW": 2}
CONFIDENCES = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
UNKNOWN_RANK = 99
#: Policy presets: least severity and confidence.
POLICIES = {"balanced": ("LOW", "LOW"), "strict": ("MEDIUM", "MEDIUM")}

#: Extension to tier and language: fixed values.
EXTENSIONS = {
    ".py": ("tier1", "python"), ".js": ("tier1", "javascript"), ".ts": ("tier1", "typescript"), ".jsx": ("tier1", "javascript"),
    ".tsx": ("tier1", "typescript"), ".mjs": ("tier1", "javascript"), ".cjs": ("tier1", "javascript"),
    ".sh": ("tier2", "bash"), ".bash": ("tier2", "bash"), ".zsh": ("tier2", "bash"),
    ".json": ("tier2", "json"), ".yaml": ("tier2", "yaml"), ".yml": ("tier2", "yaml"),
    ".go": ("tier2", "go"), ".java": ("tier2", "java"), ".kt": ("tier2", "kotlin"), ".kts": ("tier2", "kotlin"),
    ".php": ("tier2", "php"), ".phtml": ("tier2", "php"), ".php3": ("tier2", "php"), ".php4": ("tier2", "php"), ".php5": ("tier2", "php"),
    ".rb": ("tier2", "ruby"), ".erb": ("tier2", "ruby"), ".rake": ("tier2", "ruby"),
    ".env": ("secrets", "env"), ".ini": ("secrets", "ini"), ".cfg": ("secrets", "ini"), ".toml": ("secrets", "toml"), ".conf": ("secrets", "conf"),
}
#: Directories that a scan never enters (besides those that begin with a dot): fixed values.
SKIPPED_FOLDERS = frozenset(("node_modules", "__pycache__", "venv", "env", "dist", "build", "vendor", "third_party", "bower_components"))
#: Largest file that is scanned, and the head in which a file without extension is searched for a NUL byte.
MOST_BYTES, PROBE_BYTES = 512 * 1024, 8192
#: Files admitted by name alone.
NAMES = frozenset((".env", ".envrc", "dockerfile"))

#: Rules whose confidence calibration sets: fixed values.
LOW_RULES = ("SEC014",)
MEDIUM_RULES = ("SEC013", "CFG001", "CFG002", "CFG003", "CRY003", "CRY102", "LOG001", "RACE001", "MASS001", "TEMP001")
TAINT_RULES = ("SQL001", "CMD001", "CMD002", "SSRF001", "PATH001", "PATH002", "SSTI001", "SQL101", "CMD101", "CMD102", "CMD103", "SSRF101", "XSS101", "XSS102", "PATH101")

#: Manifest file name to ecosystem.
MANIFESTS = {
    "requirements.txt": "PyPI", "requirements-dev.txt": "PyPI", "requirements-prod.txt": "PyPI", "requirements-test.txt": "PyPI",
    "package.json": "npm", "go.mod": "Go", "Gemfile.lock": "RubyGems",
}

#: Scripts: objects whose members hold request data, what else does, and calls that clean it. Fixed values that decide results.
SCRIPT_OBJECTS = ("req", "request", "params", "query", "body", "location")
SCRIPT_NAMES = ("document.URL", "userInput", "getParam")
SCRIPT_CLEANERS = ("encodeURIComponent", "DOMPurify.sanitize", "sanitizeHtml", "escapeHtml")
#: Keys of credentials, parts of a key set apart by nothing, a hyphen, an underscore or a dot. Fixed values that decide results.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token")
SECRET_PHRASES = ("api key", "auth key", "private key", "client secret", "access key", "signing key", "encryption key", "db pass", "db password", "database pass", "database password")
#: Values of credentials that are to be filled in. Fixed values that decide results.
FILL_IN = ("your", "change", "insert", "replace", "example", "placeholder")
