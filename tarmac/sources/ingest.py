"""Reading recordings: CSV variants to canonical columns, side tables, and writing results."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical name -> patterns of which a header must match every one.
PHONE = {
    "lat": ("LATITUDE",), "lon": ("LONGITUDE",), "alt": ("ALTITUDE",), "speed": ("GPS", "SPEED"), "gps_acc": ("GPS", "ACCURACY"), "heading_deg": ("GPS", "ORIENTATION"),
    "acc_x": ("ACCELEROMETER", r"\bX\b"), "acc_y": ("ACCELEROMETER", r"\bY\b"), "acc_z": ("ACCELEROMETER", r"\bZ\b"),
    "grav_x": ("GRAVITY", r"\bX\b"), "grav_y": ("GRAVITY", r"\bY\b"), "grav_z": ("GRAVITY", r"\bZ\b"),
    "gyr_yaw": ("GYROSCOPE", "YAW"), "gyr_pitch": ("GYROSCOPE", "PITCH"), "gyr_roll": ("GYROSCOPE", "ROLL"),
}
ECU = {
    "lat": ("LATITUDE",), "lon": ("LONGITUDE",), "speed_kmh": ("^VELOCITY",), "heading_deg": ("HEADING",), "long_g": ("LONGITUDINAL ACCEL",), "lat_g": ("LATERAL ACCEL",), "yaw_dps": ("YAW RATE",),
    "wheel_fl": ("WHEEL SPEED", "FL|FRONT LEFT"), "wheel_fr": ("WHEEL SPEED", "FR|FRONT RIGHT"), "wheel_rl": ("WHEEL SPEED", "RL|REAR LEFT"), "wheel_rr": ("WHEEL SPEED", "RR|REAR RIGHT"),
}
G, KMH = 9.80665, 1 / 3.6


def norm(name: str) -> str:
    """Upper case, blanks collapsed."""
    return re.sub(r"\s+", " ", name.strip()).upper()


def find(columns: list[str], *patterns: str) -> str | None:
    """The first column that matches every pattern."""
    return next((c for c in columns if all(re.search(p, norm(c)) for p in patterns)), None)


def schema_hash(columns: list[str]) -> str:
    return hashlib.sha1("|".join(sorted(map(norm, columns))).encode()).hexdigest()[:12]


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All-string columns of Latin-1 CSV files of one header; the nameless column that a trailing comma makes goes."""
    df = spark.read.option("header", "true").option("encoding", "ISO-8859-1").option("ignoreLeadingWhiteSpace", "true").csv(path)
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not re.fullmatch(r"_c\d+", c)))


def number(c: str) -> Column:
    """A double, or null where the text isn't a finite one."""
    v = F.col(f"`{c}`").try_cast("double")
    return F.when(~F.isnan(v), v)


def time_scale(header: str | None) -> float | None:
    """Seconds a unit of a time column by its header; None if it doesn't say."""
    h = norm(header or "")
    if "(MS)" in h or "MILLISEC" in h:
        return 1e-3
    return 1.0 if "SECOND" in h else None


def canonical(df: DataFrame, family: str, session: Column, row: Column | None = None) -> DataFrame:
    """Canonical columns of a recording: family, session, row_idx, time_s, speed_ms and the family's channels; null where a header is missing.

    The header decides the time unit. Without a word there, milliseconds are taken
    where the median step is over 10. The phone's speed is in m/s whatever it says.
    """
    names = PHONE if family == "S" else ECU
    columns = df.columns
    out = {k: number(c) if (c := find(columns, *p)) else F.lit(None).cast("double") for k, p in names.items()}
    t = find(columns, "TIME SINCE START") or find(columns, r"\bTIME\b")
    scale = time_scale(t)
    rows = df.withColumn("__row", row if row is not None else F.monotonically_increasing_id())
    if t and scale is None:
        ends = rows.select(number(t).alias("t"), "__row").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("t").alias("n")).first()
        scale = 1e-3 if ends["n"] and ends["n"] > 1 and (ends["b"] - ends["a"]) / (ends["n"] - 1) > 10 else 1.0
    time = number(t) * scale if t else F.lit(None).cast("double")
    speed = out["speed"] if family == "S" else out.pop("speed_kmh") * KMH
    out.pop("speed", None)
    rest = {k: c for k, c in out.items() if k != "speed_kmh"}
    return rows.select(F.lit(family).alias("family"), session.alias("session"), F.col("__row").alias("row_idx"), time.alias("time_s"), speed.alias("speed_ms"), *(c.alias(k) for k, c in rest.items()))


def load(spark: SparkSession, sessions: DataFrame) -> DataFrame:
    """All recordings of a catalogue (family, session, path) in canonical columns.

    The driver reads headers alone; files of one family and header are one read.
    """
    parts, by = [], {}
    for r in sessions.select("family", "session", "path").collect():
        head = spark.read.option("encoding", "ISO-8859-1").text(r["path"]).first()
        columns = [c.strip() for c in (head[0] if head else "").split(",")]
        by.setdefault((r["family"], schema_hash(columns)), []).append((r["path"], r["session"]))
    for (family, _), files in sorted(by.items()):
        raw = read_raw(spark, [p for p, _ in files])
        name = F.regexp_extract(F.input_file_name(), r"[SVsv]-([^/]+)\.csv$", 1)
        parts.append(canonical(raw, family, name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def date_seconds(df: DataFrame, session: str, date: str, formats: list[str], least: int = 10) -> DataFrame:
    """``df`` with date_s: seconds since the session's first date of 2015 to 2025; null for sessions with under ``least`` such dates."""
    from pyspark.sql import Window

    text = F.regexp_replace(date, r":(\d{1,3})$", ".$1")
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
    ok = F.when(F.year(parsed).between(2015, 2025), F.unix_micros(parsed) / 1e6)
    own = Window.partitionBy(session)
    rows = df.withColumn("__s", ok)
    return rows.withColumn("date_s", F.when(F.count("__s").over(own) >= least, F.col("__s") - F.min("__s").over(own))).drop("__s")


def read_side(spark: SparkSession, path: str) -> DataFrame:
    """A small CSV with # comments."""
    return spark.read.option("header", "true").option("comment", "#").option("inferSchema", "true").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends records as JSON lines."""
    df.write.mode("append").json(path)


def report(df: DataFrame, title: str, limit: int = 200) -> str:
    """A small result as a Markdown table; ``limit`` rows at most reach the driver."""
    rows = df.limit(limit).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
