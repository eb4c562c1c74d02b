"""Hide files that ignore lists name, by the rules of a .gitignore file.

A list may hold a handful of patterns or, where unsupported files are added to
it, one name per file.  Plain names are therefore matched by an equi-join on
(directory, name).  The patterns with wildcards of a directory, which someone has
written, are one ordered list: each path below the directory meets it once, and
the last one that matches decides.
"""

from pyspark.sql import Column, DataFrame, functions as F


def _glob_regex(glob: Column) -> Column:
    """A wildcard pattern as a regular expression over a relative path."""
    steps = (
        (r"\\(.)", r"[$1]"),
        (r"([.+^$(){}|])", r"\\$1"),
        (r"\[!", "[^"),
        (r"^\*\*/", "\u0001"),
        (r"/\*\*/", "/\u0001"),
        (r"/\*\*$", "/\u0002"),
        (r"\*+", "[^/]*"),
        (r"\?", "[^/]"),
        ("\u0001", "(?:.*/)?"),
        ("\u0002", ".+"),
    )
    for pattern, replacement in steps:
        glob = F.regexp_replace(glob, pattern, replacement)
    return F.concat(F.lit("(?s)^"), glob, F.lit("$"))


def parse_rules(rules: DataFrame) -> DataFrame:
    """(dir, line_no, pattern) lines as tests; blank lines and comments go."""
    line = F.regexp_replace("pattern", r"(?<!\\)\s+$", "")
    kept = rules.withColumn("_line", line).where(~F.col("_line").rlike(r"^(#|$)"))
    negated = F.startswith("_line", F.lit("!"))
    body = F.regexp_replace("_line", r"^!", "")
    dir_only = F.endswith("_body", F.lit("/"))
    inner = F.regexp_replace("_body", r"/$", "")
    anchored = F.contains("_inner", F.lit("/"))
    text = F.regexp_replace("_inner", r"^/", "")
    # A backslash before a plain leading character only protects it.
    text = F.regexp_replace(text, r"^\\([#!])", "$1")
    return (
        kept.withColumn("negated", negated)
        .withColumn("_body", body)
        .withColumn("dir_only", dir_only)
        .withColumn("_inner", inner)
        .withColumn("anchored", anchored)
        .select(
            F.regexp_replace("dir", r"/+$", "").alias("dir"),
            F.col("line_no").cast("long").alias("line_no"),
            "negated",
            "dir_only",
            "anchored",
            text.alias("text"),
            (~text.rlike(r"[*?\[\\]")).alias("plain"),
        )
    )


def _steps(files: DataFrame) -> DataFrame:
    """Each file with every path on the way from the top to it."""
    parts = F.split("path", "/")
    return files.select("path", parts.alias("_parts")).select(
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(2), F.size("_parts")),
                lambda i: F.struct(
                    F.array_join(F.slice("_parts", F.lit(1), i), "/").alias("step"),
                    (i < F.size("_parts")).alias("is_dir"),
                ),
            )
        ).alias("_s"),
    ).select("path", "_s.step", "_s.is_dir")


def apply_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no rule hides.

    A file is hidden when it, or a directory above it, is.  For one path the
    rule in the deepest directory decides, and there the last line; a rule that
    starts with '!' shows again what an earlier one hid.
    """
    tests = parse_rules(rules)
    steps = _steps(files)
    below = (
        steps.select("step", "is_dir")
        .distinct()
        .withColumn("_p", F.split("step", "/"))
        .select(
            "step",
            "is_dir",
            F.element_at("_p", -1).alias("_name"),
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("_p") - 1),
                    lambda j: F.struct(
                        j.alias("depth"),
                        F.array_join(F.slice("_p", F.lit(1), j), "/").alias("dir"),
                        F.array_join(F.slice("_p", j + 1, F.size("_p")), "/").alias("rel"),
                    ),
                )
            ).alias("_a"),
        )
        .select("step", "is_dir", "_a.depth", "_a.dir", "_name", "_a.rel")
    )
    fits = F.col("is_dir") | ~F.col("dir_only")
    hit = ["step", "depth", "line_no", "negated"]
    by_name = below.select(
        "step",
        "is_dir",
        "depth",
        "dir",
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("anchored"), F.col("_name").alias("text")),
                F.struct(F.lit(True).alias("anchored"), F.col("rel").alias("text")),
            )
        ).alias("_c"),
    ).select("step", "is_dir", "depth", "dir", "_c.anchored", "_c.text")
    plain = by_name.join(
        tests.where("plain").drop("plain"), ["dir", "anchored", "text"], "inner"
    )
    wild = (
        tests.where("NOT plain")
        .withColumn("regex", _glob_regex(F.col("text")))
        .groupBy("dir")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("line_no", "negated", "dir_only", "anchored", "regex")), asc=False
            ).alias("_rules")
        )
    )

    def matches(rule: Column) -> Column:
        tested = F.when(rule["anchored"], F.col("rel")).otherwise(F.col("_name"))
        return (F.col("is_dir") | ~rule["dir_only"]) & F.rlike(tested, rule["regex"])

    last = F.get(F.filter("_rules", matches), F.lit(0))
    globs = below.join(wild, "dir").withColumn("_last", last).where(F.col("_last").isNotNull())
    globs = globs.select("step", "depth", "_last.line_no", "_last.negated")
    hidden = (
        plain.where(fits)
        .select(*hit)
        .unionByName(globs.select(*hit))
        .groupBy("step")
        .agg(F.max_by("negated", F.struct("depth", "line_no")).alias("_shown"))
        .where("NOT _shown")
    )
    hidden_files = steps.join(hidden, "step", "left_semi").select("path").distinct()
    return files.join(hidden_files, "path", "left_anti")
