"""Session discovery, roles, exclusions and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Trees of the corpus in order of preference, and the rates (Hz) that roles must hold.
TREES = [("Synchronised", "Categorised"), ("Synchronised", "Uncategorised"), ("Unsynchronised", "Categorised"), ("Unsynchronised", "Uncategorised")]
RATES = {"train": (8.0, 12.0), "validate": (8.0, 12.0), "test": (8.0, 12.0), "ood_spotcheck": (8.0, 12.0), "stage0_only": (8.0, 12.0), "robustness_2hz": (1.6, 2.4)}


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path of every CSV under a folder; the listing is Spark's, so any store will do. No content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(root).select("path")


def discover(files: DataFrame) -> DataFrame:
    """family, session, tree, subtree, path: of files of a session the one in the preferred tree, ties by path."""
    name = F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    rows = files.withColumns({"family": F.upper(F.regexp_extract(name, r"^([SVsv])-(.+)$", 1)), "session": F.regexp_extract(name, r"^([SVsv])-(.+)$", 2)}).filter("session <> ''")
    place = F.lit(len(TREES))
    for k, (tree, sub) in reversed(list(enumerate(TREES))):
        place = F.when(F.col("path").contains(f"/{tree}/{sub}/") | F.col("path").startswith(f"{tree}/{sub}/"), k).otherwise(place)
    rows = rows.withColumn("priority", place)
    first = F.row_number().over(Window.partitionBy("family", F.lower("session")).orderBy("priority", "path"))
    chosen = rows.withColumn("__k", first).filter("__k = 1")
    tree = F.element_at(F.array(*(F.lit(t) for t, _ in TREES), F.lit("?")), F.col("priority") + 1)
    sub = F.element_at(F.array(*(F.lit(s) for _, s in TREES), F.lit("?")), F.col("priority") + 1)
    return chosen.select("family", "session", tree.alias("tree"), sub.alias("subtree"), "path")


def group_of(session: Column, groups: list[str]) -> Column:
    """The longest known group that the name begins with, whatever its case, or ?."""
    out = F.lit("?")
    for g in sorted(groups, key=lambda g: (len(g), g)):
        out = F.when(F.lower(session).startswith(g.lower()), g).otherwise(out)
    return out


def with_roles(sessions: DataFrame, groups: list[str], exclusions: DataFrame, tests: list[str], validation: list[str], slow: list[str], ood: list[str], train: list[str]) -> DataFrame:
    """``sessions`` with group, role and exclusion_reason; a session without a role is an error.

    ECU recordings are stage0_only. Then, in this order: excluded, test sessions,
    2 Hz groups, out-of-distribution, validation and training groups.
    """
    listed = exclusions.select(F.lower("session").alias("__key"), F.col("reason").alias("exclusion_reason"))
    rows = sessions.withColumn("group", group_of(F.col("session"), groups)).join(F.broadcast(listed), F.lower("session") == F.col("__key"), "left").drop("__key")
    rows = rows.withColumn("exclusion_reason", F.when(F.col("family") == "S", F.col("exclusion_reason")))
    of = lambda names: F.col("group").isin(*names) if names else F.lit(False)
    role = (
        F.when(F.col("family") == "V", "stage0_only").when(F.col("exclusion_reason").isNotNull(), "excluded").when(F.lower("session").isin(*[t.lower() for t in tests]), "test")
        .when(of(slow), "robustness_2hz").when(of(ood), "ood_spotcheck").when(of(validation), "validate").when(of(train), "train")
        .otherwise(F.raise_error(F.concat(F.lit("no role for "), F.col("session"))))
    )
    return rows.withColumn("role", role)


def resolve(sessions: DataFrame, name: str) -> DataFrame:
    """The one session called ``name`` (S-Vw12, Vw12.csv, Vw12); none or several are an error."""
    plain = name.removesuffix(".csv")
    family, _, rest = plain.partition("-")
    same = (F.col("family") == family.upper()) & (F.lower("session") == rest.lower()) if rest and family.upper() in ("S", "V") else F.lower("session") == plain.lower()
    found = sessions.filter(same).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{len(found)} sessions are called {name}")
    return sessions.filter(same)


def rate_gate(rates: DataFrame) -> DataFrame:
    """``rates`` (session, role, hz) with ok: the role's band holds the rate; roles without a band pass."""
    out = F.lit(True)
    for role, (low, high) in sorted(RATES.items()):
        out = F.when(F.col("role") == role, F.coalesce(F.col("hz").between(low, high), F.lit(False))).otherwise(out)
    return rates.withColumn("ok", out)


def attach(sessions: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """A side table's column by session name, whatever its case; null where it has none."""
    own = side.select(F.lower("session").alias("__key"), column)
    return sessions.join(own, F.lower("session") == F.col("__key"), "left").drop("__key")


def leakage(windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """check, failures: one role a session, one build a session, rising starts, one window length, roles as in the catalogue."""
    per = windows.groupBy("session").agg(F.countDistinct("role").alias("roles"), F.countDistinct("build").alias("builds"), F.countDistinct("width").alias("widths"))
    own = Window.partitionBy("session").orderBy("position")
    falls = windows.withColumn("__d", F.col("t0") - F.lag("t0").over(own)).filter("__d <= 0").groupBy().agg(F.count("*").alias("n"))
    roles = windows.select("session", "role").distinct().join(sessions.select("session", F.col("role").alias("listed")), "session", "left").filter("listed is null or listed <> role")
    one = lambda name, df: df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
    return (
        one("one_role", per.filter("roles > 1")).union(one("one_build", per.filter("builds > 1"))).union(one("one_width", per.filter("widths > 1")))
        .union(falls.select(F.lit("rising_starts"), "n")).union(one("listed_role", roles))
    )


def paired(sessions: DataFrame) -> DataFrame:
    """Names that both families have, lower-cased."""
    names = lambda f: sessions.filter(F.col("family") == f).select(F.lower("session").alias("session"))
    return names("S").intersect(names("V"))
