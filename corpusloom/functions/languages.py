"""Fence language of a file name extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension

# Extension -> language of the Markdown fence (case-sensitive).
FENCE_LANGUAGE = {
    "rs": "rust",
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "html": "html",
    "htm": "html",
    "css": "css",
    "scss": "scss",
    "sass": "scss",
    "less": "less",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "toml": "toml",
    "xml": "xml",
    "md": "markdown",
    "markdown": "markdown",
    "sh": "bash",
    "bash": "bash",
    "zsh": "bash",
    "rb": "ruby",
    "php": "php",
    "java": "java",
    "kt": "kotlin",
    "kts": "kotlin",
    "swift": "swift",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cxx": "cpp",
    "cc": "cpp",
    "hpp": "cpp",
    "hxx": "cpp",
    "hh": "cpp",
    "cs": "csharp",
    "go": "go",
    "dart": "dart",
    "lua": "lua",
    "pl": "perl",
    "pm": "perl",
    "r": "r",
    "scala": "scala",
    "sql": "sql",
    "vb": "vbnet",
    "vue": "vue",
    "svelte": "svelte",
    "tf": "hcl",
    "tfvars": "hcl",
    "gradle": "groovy",
    "dockerfile": "dockerfile",
    "ini": "ini",
    "bat": "batch",
    "cmd": "batch",
    "ps1": "powershell",
    "graphql": "graphql",
    "gql": "graphql",
    "proto": "protobuf",
}


def fence_language(path: Column | str) -> Column:
    """Language tag for a path, '' when the extension is unknown."""
    pairs = ",".join(f"{ext}:{language}" for ext, language in FENCE_LANGUAGE.items())
    table = F.str_to_map(F.lit(pairs), F.lit(","), F.lit(":"))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(""))
