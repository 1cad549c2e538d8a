"""File records: what a path is, what may be read, what changed since the last scan, what must be parsed anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.globs import last_match

# Kinds by name and extension; patterns of files that are never read; defaults of a scan.
CONFIG_NAMES = "tsconfig.json jsconfig.json package.json pnpm-workspace.yaml bunfig.toml Dockerfile Makefile .editorconfig .gitignore .npmrc".split()
CONFIG_EXTENSIONS = ".json .yaml .yml .toml .ini .cfg .properties".split()
DOC_EXTENSIONS = ".md .mdx .markdown .txt .rst".split()
ASSET_EXTENSIONS = ".css .scss .sass .less .svg .png .jpg .jpeg .gif .webp .ico .woff .woff2 .ttf .eot .mp4 .pdf".split()
SOURCE_EXTENSIONS = ".ts .tsx .mts .cts .js .jsx .mjs .cjs .vue .svelte".split()
TEST_PATH = r"(^|/)(tests?|__tests__|__mocks__|e2e)/|\.(test|spec)\.[cm]?[jt]sx?$|\.(test|spec)\.(md|json)$"
SENSITIVE = (
    "**/.env **/.env.* **/*.env **/.npmrc **/.pypirc **/.netrc **/.htpasswd **/.git-credentials **/credentials **/credentials.* **/secrets **/secrets.* **/*.pem **/*.key **/*.p12 **/*.pfx **/*.jks **/*.keystore **/*.crt **/id_rsa* **/id_ed25519* **/.ssh/** **/service-account*.json"
).split()
EXCLUDE = "node_modules/** dist/** build/** out/** coverage/** vendor/** target/** .git/** .agent/** .cache/** .next/** .turbo/** .venv/** __pycache__/**".split()
INCLUDE = "src/** packages/** apps/** lib/** test/** tests/** **/*.md *.json *.{ts,tsx,mts,cts,js,jsx,mjs,cjs,vue,svelte}".split()
LARGEST = 1_048_576
LANGUAGES = {"typescript": ".ts .tsx .mts .cts", "javascript": ".js .jsx .mjs .cjs", "markdown": ".md .mdx .markdown", "json": ".json"}


def kind_of(path: Column, signals: Column | None = None) -> Column:
    """test, docs, config, asset, source or other; the first that fits."""
    p = P.to_posix(path)
    name, ext = P.basename(p), F.lower(P.extname(p))
    test = p.rlike(TEST_PATH)
    if signals is not None:
        test = test | F.coalesce(F.array_contains(signals, "test:suite"), F.lit(False))
    config = name.isin(CONFIG_NAMES) | ext.isin(CONFIG_EXTENSIONS) | name.rlike(r"\.config\.[cm]?[jt]s$") | p.startswith(".github/") | (name.startswith(".") & (F.length(name) > 1))
    return F.when(test, "test").when(ext.isin(DOC_EXTENSIONS), "docs").when(config, "config").when(ext.isin(ASSET_EXTENSIONS), "asset").when(ext.isin(SOURCE_EXTENSIONS), "source").when(p.isNotNull(), "other")


def language_of(path: Column) -> Column:
    """By name first, then by extension; unknown otherwise."""
    name, ext = P.basename(path), F.lower(P.extname(path))
    out = F.when(name == "package.json", "package-json").when(name.isin("tsconfig.json", "tsconfig.base.json", "tsconfig.build.json", "jsconfig.json"), "tsconfig")
    for language, extensions in LANGUAGES.items():
        out = out.when(ext.isin(extensions.split()), language)
    return out.when(path.isNotNull(), "unknown")


def is_sensitive(path: Column, extra: list[str] | None = None, allow: bool = False) -> Column:
    """A file that must not be read; decided by its path, before its content is touched."""
    return F.lit(False) if allow else last_match(path, [*SENSITIVE, *(extra or [])])


def records(files: DataFrame, extra_sensitive: list[str] | None = None, allow_sensitive: bool = False, largest: int = LARGEST) -> DataFrame:
    """``repo, path, hash, size, language, kind, sensitive, too_large`` of files (repo, path, text). Sensitive and
    oversized ones are not hashed (hash '')."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    r = files.select("repo", "path", size.alias("size"), is_sensitive(F.col("path"), extra_sensitive, allow_sensitive).alias("sensitive"), "text").withColumn("too_large", F.col("size") > largest)
    blocked = F.col("sensitive") | F.col("too_large")
    kind = F.when(F.col("sensitive"), "other").otherwise(kind_of(F.col("path")))
    language = F.when(F.col("sensitive"), "unknown").otherwise(language_of(F.col("path")))
    return r.select("repo", "path", F.when(blocked, "").when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("hash"), "size", language.alias("language"), kind.alias("kind"), "sensitive", "too_large")


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``repo, path, change`` (added, modified, unchanged, deleted) of two listings (repo, path, hash, size, mtime_ms;
    current also ``blocked``). Same size and time as before: unchanged without looking at the hash. Blocked files
    (never hashed) are unchanged. One full outer join on (repo, path)."""
    p = previous.select("repo", "path", F.col("hash").alias("old"), F.col("size").alias("old_size"), F.col("mtime_ms").alias("old_time"), F.lit(True).alias("was"))
    c = current.select("repo", "path", "hash", "size", "mtime_ms", "blocked", F.lit(True).alias("now"))
    touched = ~((F.col("old") != "") & F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime_ms").eqNullSafe(F.col("old_time")))
    same = (F.col("hash") != "") & (F.col("hash") == F.col("old"))
    kind = F.when(F.col("now").isNull(), "deleted").when(F.col("blocked"), "unchanged").when(F.col("was").isNull(), "added").when(F.coalesce(same, F.lit(False)) | ~F.coalesce(touched, F.lit(True)), "unchanged").otherwise("modified")
    return p.join(c, ["repo", "path"], "full_outer").select("repo", "path", kind.alias("change"))


def to_parse(files: DataFrame, cache: DataFrame, by: tuple[str, ...] = ("hash", "language")) -> tuple[DataFrame, DataFrame]:
    """(files whose content no cached facts exist for, files with cached facts), by content and reader.

    ``files``: repo, path and the columns of ``by``. ``cache``: those of ``by``, …; several files may share an entry,
    which carries no path."""
    key = list(by)
    known = cache.select(*key).distinct()
    return files.join(known, key, "left_anti"), files.join(cache.dropDuplicates(key), key)


def duplicates(files: DataFrame) -> DataFrame:
    """``hash, copies, first_repo, first_path`` of contents that stand in more than one file."""
    least = F.min(F.struct("repo", "path"))
    return files.filter("hash IS NOT NULL AND hash <> ''").groupBy("hash").agg(F.count("*").alias("copies"), least.alias("f")).filter("copies > 1").select("hash", "copies", F.col("f.repo").alias("first_repo"), F.col("f.path").alias("first_path"))


def status(changed: DataFrame, has_state: bool) -> DataFrame:
    """``repo, state, added, modified, deleted``: up-to-date, stale, or missing where there was no earlier scan."""
    n = lambda k: F.count_if(F.col("change") == k).alias(k)
    out = changed.groupBy("repo").agg(n("added"), n("modified"), n("deleted"))
    state = F.lit("missing") if not has_state else F.when(F.col("added") + F.col("modified") + F.col("deleted") == 0, "up-to-date").otherwise("stale")
    return out.withColumn("state", state)
