"""What a repository is, by rules over paths and texts: project type, frameworks, configuration, tests, entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.paths import first_segment
from quarrylight.operators.graph import entry_kind

#: (kind, name, pattern of the path, pattern of the text or ""), in the syntax that Java and RE2 share; fixed values.
RULES = (
    ("project", "rust", "(^|/)Cargo[.]toml$", ""), ("project", "node", "(^|/)package[.]json$", ""), ("project", "python", "(^|/)(pyproject[.]toml|setup[.]py|requirements[.]txt)$", ""), ("project", "go", "(^|/)go[.]mod$", ""),
    ("project", "java", "(^|/)(pom[.]xml|build[.]gradle)$", ""), ("project", "kotlin", "(^|/)build[.]gradle[.]kts$", ""), ("project", "php", "(^|/)composer[.]json$", ""), ("project", "ruby", "(^|/)Gemfile$", ""), ("project", "csharp", "[.](csproj|sln)$", ""), ("project", "zig", "(^|/)build[.]zig$", ""), ("project", "cpp", "(^|/)CMakeLists[.]txt$", ""),
    ("framework", "react", "(^|/)package[.]json$", "\"react\"\\s*:"), ("framework", "next", "(^|/)next[.]config[.](js|mjs|ts)$", ""), ("framework", "vue", "(^|/)package[.]json$", "\"vue\"\\s*:"), ("framework", "svelte", "(^|/)svelte[.]config[.]js$", ""), ("framework", "angular", "(^|/)angular[.]json$", ""), ("framework", "express", "(^|/)package[.]json$", "\"express\"\\s*:"),
    ("framework", "django", "(^|/)manage[.]py$", "django"), ("framework", "flask", "[.]py$", "(^|\\n)\\s*(from|import) flask\\b"), ("framework", "fastapi", "[.]py$", "(^|\\n)\\s*(from|import) fastapi\\b"), ("framework", "rails", "(^|/)Gemfile$", "['\"]rails['\"]"), ("framework", "laravel", "(^|/)artisan$", ""),
    ("framework", "axum", "(^|/)Cargo[.]toml$", "(^|\\n)axum\\s*="), ("framework", "actix", "(^|/)Cargo[.]toml$", "(^|\\n)actix-web\\s*="), ("framework", "tokio", "(^|/)Cargo[.]toml$", "(^|\\n)tokio\\s*="), ("framework", "spring", "(^|/)(pom[.]xml|build[.]gradle(?:[.]kts)?)$", "spring-boot"), ("framework", "gin", "(^|/)go[.]mod$", "gin-gonic/gin"),
    ("config", "docker", "(^|/)(Dockerfile|docker-compose[.]ya?ml)$", ""), ("config", "ci", "(^|/)[.](github/workflows/[^/]+|gitlab-ci)[.]ya?ml$", ""), ("config", "typescript", "(^|/)tsconfig[^/]*[.]json$", ""), ("config", "lint", "(^|/)([.]eslintrc[^/]*|rustfmt[.]toml|[.]rubocop[.]yml|ruff[.]toml)$", ""), ("config", "make", "(^|/)(Makefile|justfile)$", ""),
    ("tests", "folder", "(^|/)(tests?|__tests__|spec)/", ""), ("tests", "python", "(^|/)(test_[^/]*|[^/]*_test)[.]py$", ""), ("tests", "go", "_test[.]go$", ""), ("tests", "script", "[.](test|spec)[.](js|ts|jsx|tsx)$", ""), ("tests", "ruby", "_spec[.]rb$", ""), ("tests", "inline", "[.]rs$", "#\\[cfg\\(test\\)\\]"),
    ("layout", "examples", "(^|/)examples/", ""), ("layout", "docs", "(^|/)docs/", ""), ("layout", "benches", "(^|/)benches/", ""), ("layout", "workspace", "(^|/)(packages|crates|services|modules)/", ""),
)


def detected(files: DataFrame) -> DataFrame:
    """(repository, kind, name): the rules that some file of a repository meets; every file is read once for all rules."""
    content = F.coalesce("content", F.lit(""))
    met = [F.when(F.col("path").rlike(path) & (content.rlike(text) if text else F.lit(True)), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"))) for kind, name, path, text in RULES]
    each = files.select(first_segment(F.col("path")).alias("repository"), F.explode(F.array_compact(F.array(*met))).alias("r"))
    return each.select("repository", "r.*").distinct()


def bundle(files: DataFrame) -> dict[str, DataFrame]:
    """The parts of a repository context by name: what is detected, the entry points, the size per language and folder."""
    by_language = files.groupBy(first_segment(F.col("path")).alias("repository"), "language").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"))
    entries = files.select(first_segment(F.col("path")).alias("repository"), "path", entry_kind(F.col("path")).alias("kind")).where("kind IS NOT NULL")
    tree = files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    return {"detected": detected(files), "entry_points": entries, "languages": by_language, "structure": tree}
