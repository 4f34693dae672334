"""Delimited, JSON and GeoJSON files of unknown origin, and configuration files."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import MISSING, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, encoding): the most frequent of ; tab , in the first line, and Latin-1 if any line is no UTF-8."""
    lines = spark.read.text(path)
    first = lines.first()
    head = first[0] if first else ""
    broken = lines.where(~F.is_valid_utf8("value")).limit(1).count()
    return max(";\t,", key=head.count), "ISO-8859-1" if broken else "UTF-8"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """Rows of a file with a header; without a schema all columns are text. A byte order mark is no part of the first name."""
    found = sniff(spark, path) if sep is None or encoding is None else (sep, encoding)
    reader = spark.read.option("header", True).option("sep", sep or found[0]).option("encoding", encoding or found[1]).option("enforceSchema", True)
    if schema:
        return reader.schema(schema).csv(path)
    frame = reader.csv(path)
    return frame.toDF(*(c.lstrip(BOM).strip() for c in frame.columns))


def _plain(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))


def find_column(frame: DataFrame, *keywords: str, required: bool = True) -> str | None:
    """The first column whose name holds all keywords, whatever their case and accents."""
    for name in frame.columns:
        if all(_plain(k) in _plain(name) for k in keywords):
            return name
    if required:
        raise ValueError(f"no column holds {', '.join(keywords)}; there are {', '.join(frame.columns)}")
    return None


def require_columns(frame: DataFrame, required: list[str], name: str) -> DataFrame:
    missing = [c for c in required if c not in frame.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return frame


def without_empty_columns(frame: DataFrame) -> DataFrame:
    """Drops columns named Unnamed... and columns without any value."""
    named = [c for c in frame.columns if not c.startswith("Unnamed")]
    filled = frame.agg(*(F.count(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(named))).first() if named else []
    return frame.select(*(F.col(f"`{c}`") for c, n in zip(named, filled, strict=True) if n))


def decimal(text: Column) -> Column:
    """Numbers with a decimal comma and thousands dots, or with a decimal point; null if neither."""
    x = F.trim(text)
    return F.when(x.contains(","), F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(x).try_cast("double")


def latest(frame: DataFrame, column: str) -> DataFrame:
    """Rows with the greatest value of a column; the greatest is one row."""
    most = frame.agg(F.max(column).alias("_most"))
    return frame.join(F.broadcast(most), F.col(column) == F.col("_most")).drop("_most")


def read_geojson_points(spark: SparkSession, path: str, properties: str, multiline: bool = True) -> DataFrame:
    """lon, lat and the properties (a DDL list) of point features: a collection in each file, or one feature in each line if not ``multiline``."""
    parts = {"type": "string", "properties": f"struct<{properties}>", "geometry": "struct<type: string, coordinates: array<double>>"}
    feature = ", ".join(f"{k}: {v}" for k, v in parts.items())
    whole = spark.read.schema(f"features array<struct<{feature}>>, " + ", ".join(f"{k} {v}" for k, v in parts.items())).json(path, multiLine=multiline)
    each = whole.select(F.explode(F.coalesce("features", F.array(F.struct("type", "properties", "geometry")))).alias("f"))
    points = each.where(F.col("f.geometry.type") == "Point")
    return points.select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.*")


def read_geojson_polygons(spark: SparkSession, path: str, properties: str, multiline: bool = True) -> DataFrame:
    """The properties (a DDL list) and the rings of polygon and multipolygon features: a collection in each file, or one feature in each line."""
    from lastleg.operators.zones import rings_from_coordinates

    feature = f"type string, properties struct<{properties}>, geometry struct<type: string, coordinates: string>"
    whole = spark.read.schema(f"features array<struct<{feature}>>, {feature}").json(path, multiLine=multiline)
    each = whole.select(F.explode(F.coalesce("features", F.array(F.struct("type", "properties", "geometry")))).alias("f"))
    shapes = each.where(F.col("f.geometry.type").isin("Polygon", "MultiPolygon"))
    return shapes.select("f.properties.*", rings_from_coordinates(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("rings"))


def read_offices(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, kind, name, lat) of the offices that documents hold under others.offices; private ones are named by their number."""
    office = "struct<id: bigint, isPrivate: boolean, title: string, position: struct<lat: double>>"
    o = spark.read.schema(f"others struct<offices: array<{office}>>").json(path).select(F.explode("others.offices").alias("o")).select("o.*")
    digits = F.col("id").cast("string")
    number = F.concat(F.lit("OP"), F.when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0")))
    return o.select("id", F.when(F.col("isPrivate"), "private").otherwise("office").alias("kind"), F.when(F.col("isPrivate"), number).otherwise(F.col("title")).alias("name"), F.col("position.lat").alias("lat"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def resolve_instance(spark: SparkSession, folder: str, city: str, scenario: str, size: int, instance: str | None = None, seed: int | None = None) -> str:
    """The file of a demand instance: by its id, else by its seed, else by the old name without one."""
    names = [instance] if instance else []
    names += [f"{city}_{scenario}_{size}_{seed}"] if seed is not None else []
    for name in [*names, f"{city}_{scenario}_{size}"]:
        if exists(spark, f"{folder}/{name}.csv"):
            return f"{folder}/{name}.csv"
        if name == instance:
            break  # an id that is given must be there
    raise FileNotFoundError(f"{folder} has no demand of {city}, {scenario}, {size}")


def by_header(spark: SparkSession, paths: list[str], kinds: dict[str, set[str]]) -> dict[str, DataFrame]:
    """Tables by kind: a file is of the first kind whose columns its header has; the rows of a kind are one table."""
    found: dict[str, DataFrame] = {}
    for path in paths:
        frame = read_csv(spark, path)
        kind = next((k for k, need in kinds.items() if need <= set(frame.columns)), None)
        if kind:
            found[kind] = frame if kind not in found else found[kind].unionByName(frame, allowMissingColumns=True)
    return found


def gazetteer(records: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """(label, lat, lon): every text of the named columns with its row's place; the first row and column wins."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.trim(F.col(c)).alias("label")) for k, c in enumerate(names))))
    rows = records.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*order, "lat", "lon", each.alias("x")).where(F.coalesce("x.label", F.lit("")) != "")
    first = F.struct(*order, "x.k")
    return rows.groupBy("x.label").agg(F.min_by(F.struct("lat", "lon"), first).alias("p")).select("label", "p.lat", "p.lon")


class CountingSource:
    """A paged source that holds rows 1 to n, for tests and examples: fetch(offset, limit) gives rows in a stable order."""

    schema = "id bigint, lon double"

    def __init__(self, n: int):
        self.n = n

    def fetch(self, offset: int, limit: int) -> list[tuple]:
        return [(k + 1, 2.0) for k in range(offset, min(self.n, offset + limit))]


def read_pages(spark: SparkSession, source, page: int = 2000, tries: int = 3, wave: int = 64) -> DataFrame:
    """All rows of a paged source: waves of pages, one page a task, until a page is short. A page that fails is tried again."""

    def fetch(frames):
        import pandas as pd

        names = [c.split()[0] for c in source.schema.split(", ")]
        for frame in frames:
            for offset in frame["offset"]:
                for left in range(tries - 1, -1, -1):
                    try:
                        rows = source.fetch(int(offset), page)
                        break
                    except OSError:
                        if not left:
                            raise
                yield pd.DataFrame(rows, columns=names)

    out, at = None, 0
    while True:
        from lastleg.operators.lineage import cut

        offsets = spark.range(at, at + wave).select((F.col("id") * page).alias("offset")).repartition(wave, "offset")
        rows = cut(offsets.mapInPandas(fetch, source.schema))
        out = rows if out is None else out.unionByName(rows)
        if rows.count() < wave * page:
            return out
        at += wave


def load_config(path: str, kind: type):
    """A dataclass from a JSON object; unknown keys and missing fields without a default are errors."""
    with open(path, encoding="utf-8-sig") as f:
        given = json.load(f)
    known = {x.name: x for x in fields(kind)}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    if absent := sorted(n for n, x in known.items() if n not in given and x.default is MISSING and x.default_factory is MISSING):
        raise ValueError(f"missing keys: {', '.join(absent)}")
    return kind(**given)


def pair_seeds(first: int | list[int], second: int | list[int]) -> list[tuple[int, int]]:
    """Pairs by position; a single seed goes with every one of the other list."""
    a, b = (x if isinstance(x, list) else [x] for x in (first, second))
    if len(a) != len(b) and 1 not in (len(a), len(b)):
        raise ValueError(f"{len(a)} seeds do not pair with {len(b)}")
    n = max(len(a), len(b))
    pairs = list(zip(a * (n if len(a) == 1 else 1), b * (n if len(b) == 1 else 1), strict=True))
    if len(set(pairs)) < len(pairs):
        raise ValueError("a pair of seeds is given twice")
    return pairs
