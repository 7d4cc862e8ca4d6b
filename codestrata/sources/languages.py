"""Languages by file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each language. Headers (.h) and .lua belong to none.
EXTENSIONS = {
    "Rust": "rs", "Python": "py pyi", "Java": "java", "Kotlin": "kt kts", "Go": "go", "Cpp": "cpp cc cxx hpp hh hxx", "CSharp": "cs", "Scala": "scala sc", "Ruby": "rb", "C": "c", "Swift": "swift", "Php": "php", "Dart": "dart",
    "Shell": "sh bash zsh", "Luau": "luau", "TypeScript": "ts tsx mts cts", "JavaScript": "js jsx mjs cjs", "Sql": "sql", "Html": "html htm", "Css": "css", "Scss": "scss sass", "Vue": "vue", "Svelte": "svelte", "Elixir": "ex exs",
    "Haskell": "hs", "R": "r", "Perl": "pl pm", "Json": "json", "Yaml": "yaml yml", "Toml": "toml", "Xml": "xml", "Markdown": "md", "GraphQl": "graphql gql", "Protobuf": "proto", "Terraform": "tf",
}
OTHER = "Other"


def language(path: Column) -> Column:
    """The language of a path by its name; Dockerfiles are told first, unknown extensions are Other."""
    name = F.lower(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1))
    docker = (name == "dockerfile") | name.startswith("dockerfile.") | name.endswith(".dockerfile")
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    out = F.when(docker, "Dockerfile")
    for lang, exts in EXTENSIONS.items():
        out = out.when(ext.isin(*exts.split()), lang)
    return out.otherwise(OTHER)


def line_count(text: Column) -> Column:
    """Lines as a reader counts them: a last line break opens none, an empty text has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))).cast("long")
