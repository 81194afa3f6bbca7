"""Word lists, sentences and drawing pieces that results depend on.

They are data, not logic.
"""

# This engine's own file names.  Corpora that another tool left its files in are read by handing
# ``profiles.profile_files`` and ``resolve_configs`` that tool's names, and ``ScanConfig.blacklist`` what to block.
PROFILE_FILE = ".packloomrc"
PACK_SUFFIX = ".packloom"

# Path components that block a file, compared without ASCII case.
BLACKLIST_COMPONENTS = [
    ".git",
    ".gitignore",
    ".env",
    PROFILE_FILE,
    ".svn",
    ".hg",
    "node_modules",
    "__pycache__",
    "venv",
    ".venv",
    ".pytest_cache",
    ".tox",
    "target",
    ".idea",
    ".vscode",
    ".DS_Store",
    ".npmrc",
    ".pypirc",
    ".netrc",
    "id_rsa",
    "id_dsa",
    "id_ecdsa",
    "id_ed25519",
]

# Globs that block a file by whole path or by file name, without ASCII case.
BLACKLIST_PATTERNS = [
    ".env.*",
    "credentials.json",
    "service-account*.json",
    "*.pem",
    "*.key",
    "*.p12",
    "*.pfx",
    f"*{PACK_SUFFIX}",
    f"{PACK_SUFFIX}-tmp-*",
    f"{PACK_SUFFIX}-backup-*",
]

# Option defaults.
DEFAULT_MAX_KIB = 500
DEFAULT_PROFILE = "default"
NO_DESCRIPTION = "No description"

# Sentence shown for each decision code.
DECISION_TEXT = {
    "included": "included",
    "included_lossy": "included with lossy UTF-8 replacement characters",
    "not_found": "not found",
    "outside_root": "outside the scan root",
    "current_output": "excluded because it is the current output file",
    "not_a_file": "not a content file (directory or special path)",
    "tree_disabled": "disabled by --no-tree",
    "blacklist": "blocked by blacklist",
    "ignore": "blocked by ignore filters",
    "exclude": "blocked by exclude",
    "include": "not included by include",
    "max_size": "skipped by max-size",
    "binary": "skipped because binary file",
    "unreadable": "skipped because unreadable",
}

# Pieces of the tree drawing.
TREE_LAST = "└── "
TREE_MIDDLE = "├── "
TREE_UNDER_LAST = "    "
TREE_UNDER_MIDDLE = "│   "

# Closing of a framed file.
BLOCK_CLOSING = "\n</file>\n\n"

# Why a file that passed the rules was not attached.
SKIP_TOO_LARGE = "larger than %d KiB: %d bytes"
SKIP_BINARY = "binary file"
SKIP_UNREADABLE = "unreadable: "
SKIP_DIRECTORY_LINK = "unreadable: read: Is a directory (os error 21)"

# Special tokens of the public cl100k_base encoding.
BPE_SPECIAL_TOKENS = {
    "<|endoftext|>": 100257,
    "<|fim_prefix|>": 100258,
    "<|fim_middle|>": 100259,
    "<|fim_suffix|>": 100260,
    "<|endofprompt|>": 100276,
}
