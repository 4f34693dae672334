"""More of the catalogue: text variants, ids, formats, similarity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastleg.functions import geo, text
from lastleg.operators import resolution, spatial
from lastleg.queries import query
from lastleg.sources import tables as T

# Raw facility names in several spellings, for the text functions: accents, ligatures, full-width forms, marks, blanks.
_SPELL = ["  Plaça  de l'Àngel, {k} ", "CALLE_Ñandú n.º{k}", "Ｏｆｉｃｉｎａ​ {k}", "Škoda\tŽižkov-{k}", "d'angel & fils {k}", None]


def spelled(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    raw = F.lit(None).cast("string")
    for n, s in enumerate(_SPELL):
        if s is not None:
            raw = F.when(k % len(_SPELL) == n, F.replace(F.lit(s), F.lit("{k}"), k.cast("string"))).otherwise(raw)
    return T.table(spark, d, "supplier").select(k, raw.alias("raw"))


_SPELLED = "sp AS (SELECT s_suppkey, CASE s_suppkey % {n} {c} END AS raw FROM supplier)".format(
    n=len(_SPELL), c=" ".join(f"WHEN {i} THEN replace('{s.replace(chr(39), chr(39) * 2)}', '{{k}}', s_suppkey::VARCHAR)" for i, s in enumerate(_SPELL) if s is not None)
)


@query(f"WITH {_SPELLED} SELECT s_suppkey, coalesce(trim(regexp_replace(upper(strip_accents(nfc_normalize(replace(replace(raw,'º',''),chr(8203),'')))),'[^A-Z0-9]+',' ','g')),'') AS folded FROM sp WHERE s_suppkey%6<>2")
def text_folded(spark, d):
    """Upper case, every letter's base form, all else to single spaces; null to empty. Full-width forms: see text_compatible."""
    return spelled(spark, d).where("s_suppkey % 6 <> 2").select("s_suppkey", text.fold(F.replace("raw", F.lit("º"), F.lit(""))).alias("folded"))


@query(f"WITH {_SPELLED} SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(raw,'º',''))),'[^a-z0-9_\\s]+',' ','g'),'\\s+',' ','g')) AS words FROM sp WHERE s_suppkey%6<>2")
def text_words(spark, d):
    """The variant that keeps underscores: lower case, base letters, other marks to spaces; null stays null."""
    return spelled(spark, d).where("s_suppkey % 6 <> 2").select("s_suppkey", text.words(F.replace("raw", F.lit("º"), F.lit(""))).alias("words"))


@query("SELECT s_suppkey, CASE s_suppkey%6 WHEN 2 THEN 'Oficina ' || s_suppkey WHEN 5 THEN NULL WHEN 0 THEN 'Plaça de l''Àngel, ' || s_suppkey WHEN 1 THEN 'CALLE_Ñandú n.o' || s_suppkey WHEN 3 THEN 'Škoda Žižkov-' || s_suppkey ELSE 'd''angel & fils ' || s_suppkey END AS clean, lower(CASE s_suppkey%6 WHEN 2 THEN 'Oficina ' || s_suppkey WHEN 5 THEN NULL WHEN 0 THEN 'Plaça de l''Àngel, ' || s_suppkey WHEN 1 THEN 'CALLE_Ñandú n.o' || s_suppkey WHEN 3 THEN 'Škoda Žižkov-' || s_suppkey ELSE 'd''angel & fils ' || s_suppkey END) AS key FROM supplier")
def text_compatible(spark, d):
    """The variant by compatibility forms: full-width letters become plain, zero-width spaces go, blanks are squeezed, null stays null."""
    x = spelled(spark, d).select("s_suppkey", text.compatible(F.col("raw")).alias("clean"))
    return x.select("s_suppkey", "clean", F.lower("clean").alias("key"))


@query(f"WITH {_SPELLED} SELECT s_suppkey, lower(strip_accents(replace(raw,'º',''))) AS plain, coalesce(contains(lower(strip_accents(replace(raw,'º',''))), 'nandu'), false) AS found FROM sp WHERE s_suppkey%6<>2")
def text_plain(spark, d):
    """The variant for headers: lower case without accents, nothing else changed."""
    plain = F.lower(text.base_letters(F.replace("raw", F.lit("º"), F.lit(""))))
    return spelled(spark, d).where("s_suppkey % 6 <> 2").select("s_suppkey", plain.alias("plain"), F.coalesce(plain.contains("nandu"), F.lit(False)).alias("found"))


_STREET = "CASE WHEN {k}%4=0 THEN 'Gran Via' WHEN {k}%4=1 THEN 'Calle ' || ({k}%7) || ' bis ' || ({k}%3) ELSE 'Carrer n ' || ({k}%5) END"


def _street(key: str):
    k = F.col(key)
    return F.when(k % 4 == 0, "Gran Via").when(k % 4 == 1, F.concat(F.lit("Calle "), (k % 7).cast("string"), F.lit(" bis "), (k % 3).cast("string"))).otherwise(F.concat(F.lit("Carrer n "), (k % 5).cast("string")))


@query(
    f"WITH a AS (SELECT facility_id, company, regexp_extract_all({_STREET.format(k='facility_id')}, '\\b\\d+\\b') AS n FROM fac) SELECT x.facility_id AS id_1, y.facility_id AS id_2, len(x.n)>0 AND len(y.n)>0 AS available, len(list_intersect(x.n, y.n))>0 AS same FROM a x JOIN a y ON x.company=y.company AND x.facility_id<y.facility_id",
    "fac",
)
def address_number_match(spark, d):
    """Numbers of two addresses of a company: whether both have any, and whether they share one."""
    f = T.facilities(spark, d).select("facility_id", "company", text.address_numbers(_street("facility_id")).alias("n"))
    y = f.select(F.col("facility_id").alias("id_2"), "company", F.col("n").alias("m"))
    p = f.join(y, "company").where("facility_id < id_2")
    available, same = text.compare_numbers(F.col("n"), F.col("m"))
    return p.select(F.col("facility_id").alias("id_1"), "id_2", available.alias("available"), same.alias("same"))


# Names of blocks of letters, so that SQL can say their similarity: eight letters A-G of the company, two V-Z of the code.
def _blocks(key):
    return F.concat(F.repeat(F.substring(F.lit("ABCDEFG"), (key % 7 + 1).cast("int"), F.lit(1)), F.lit(8)), F.repeat(F.substring(F.lit("VWXYZ"), (key % 5 + 1).cast("int"), F.lit(1)), F.lit(2)))


_SAME = "80.0*({a}%7={b}%7)::INT+20.0*({a}%5={b}%5)::INT"
_FAC_PAIRS = f"p AS (SELECT a.facility_id AS id_1, b.facility_id AS id_2, a.company AS c1, b.company AS c2, a.code AS k1, b.code AS k2, {geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM fac a JOIN fac b ON a.facility_id<b.facility_id WHERE {geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}<=1500)"


def _pairs(spark, d) -> DataFrame:
    """Pairs of facilities with the similarity of their addresses (by company) and of their places (by code)."""
    f = T.facilities(spark, d).select("*", _blocks(F.col("company")).alias("address"), _blocks(F.col("code")).alias("place"), text.address_numbers(_street("facility_id")).alias("numbers"))
    p = spatial.pairs_within(f, "facility_id", 1500.0)
    return p.withColumn("address_similarity", resolution.text_similarity("address_1", "address_2")).withColumn("place_similarity", resolution.text_similarity("place_1", "place_2"))


@query(f"WITH {_FAC_PAIRS} SELECT id_1 AS facility_id_1, id_2 AS facility_id_2, ({_SAME.format(a='c1', b='c2')})::DOUBLE AS similarity FROM p", "fac")
def text_similarity(spark, d):
    """100 x the Ratcliff-Obershelp ratio of two addresses."""
    return _pairs(spark, d).select("facility_id_1", "facility_id_2", F.col("address_similarity").alias("similarity"))


_GROUP = "CASE WHEN {c} IN (1,2,3,7) THEN 1 WHEN {c}=5 THEN 2 WHEN {c} IN (4,6) THEN 3 ELSE 0 END"


@query(
    f"""WITH {_FAC_PAIRS}, q AS (SELECT *, ({_SAME.format(a='c1', b='c2')}) AS sa, ({_SAME.format(a='k1', b='k2')}) AS sp, {_GROUP.format(c='k1')} AS g1, {_GROUP.format(c='k2')} AS g2,
regexp_extract_all({_STREET.format(k='id_1')}, '\\b\\d+\\b') AS n1, regexp_extract_all({_STREET.format(k='id_2')}, '\\b\\d+\\b') AS n2 FROM p),
r AS (SELECT *, g1=g2 AND g1>0 AS same_group, (sa>=80 AND (NOT (len(n1)>0 AND len(n2)>0) OR len(list_intersect(n1,n2))>0)) OR sp>=80 AS strong FROM q)
SELECT id_1, id_2, CASE WHEN same_group AND strong THEN 'Same group - strong text match' WHEN strong THEN 'Different group - kept separate' WHEN same_group AND m<=15 THEN 'Same group - close distance' WHEN same_group AND m<=30 THEN 'Manual review' WHEN same_group THEN 'Different location' ELSE 'No relation' END AS rule,
same_group AND (strong OR m<=15) AS should_cluster FROM r""",
    "fac",
)
def pair_rules(spark, d):
    """The rule of each pair: text of the address (unless its numbers differ) or of the place, then service group and distance."""
    p = _pairs(spark, d)
    g1, g2 = resolution.service_group(F.col("code_1")), resolution.service_group(F.col("code_2"))
    available, same = text.compare_numbers(F.col("numbers_1"), F.col("numbers_2"))
    strong = resolution.strong_text(F.col("address_similarity"), F.col("place_similarity"), available, same)
    rule, cluster = resolution.classify_pair((g1 == g2) & (g1 > 0), strong, F.col("distance_m"))
    return p.select(F.col("facility_id_1").alias("id_1"), F.col("facility_id_2").alias("id_2"), rule.alias("rule"), cluster.alias("should_cluster"))


_POINTS = "CASE WHEN m<=5 THEN 40 WHEN m<=10 THEN 30 WHEN m<=20 THEN 20 WHEN m<=30 THEN 10 ELSE 0 END + CASE WHEN same THEN 30 ELSE 0 END + CASE WHEN sa>=90 THEN 20 WHEN sa>=75 THEN 10 ELSE 0 END + CASE WHEN sp>=90 THEN 10 WHEN sp>=75 THEN 5 ELSE 0 END"


@query(
    f"""WITH {_FAC_PAIRS}, q AS (SELECT *, c1=c2 AS same, ({_SAME.format(a='c1', b='c2')}) AS sa, ({_SAME.format(a='k1', b='k2')}) AS sp FROM p), r AS (SELECT *, ({_POINTS})::INT AS score FROM q)
SELECT id_1, id_2, score, CASE WHEN NOT same THEN 'Co-location / nearby competitors' WHEN score>=80 THEN 'Very probable duplicate' WHEN score>=60 THEN 'Probable duplicate' WHEN score>=45 THEN 'Manual review' ELSE 'Nearby same company' END AS label,
array_to_string(list_filter([CASE WHEN m<=30 THEN 'distance' END, CASE WHEN same THEN 'company' END, CASE WHEN sa>=75 THEN 'address' END, CASE WHEN sp>=75 THEN 'place' END], lambda x: x IS NOT NULL), '; ') AS reasons,
CASE WHEN NOT same THEN 'keep both' WHEN score>=80 THEN 'merge' WHEN score>=45 THEN 'review' ELSE 'keep both' END AS action FROM r""",
    "fac",
)
def duplicate_score(spark, d):
    """Points for distance, company, address and place, their label, reasons and what to do."""
    p = _pairs(spark, d)
    same = F.col("company_1") == F.col("company_2")
    address, place, metres = F.col("address_similarity"), F.col("place_similarity"), F.col("distance_m")
    score = resolution.duplicate_score(metres, same, address, place)
    reasons = F.array(F.when(metres <= 30, "distance"), F.when(same, "company"), F.when(address >= 75, "address"), F.when(place >= 75, "place"))
    action = F.when(~same, "keep both").when(score >= 80, "merge").when(score >= 45, "review").otherwise("keep both")
    return p.select(F.col("facility_id_1").alias("id_1"), F.col("facility_id_2").alias("id_2"), score.alias("score"), resolution.duplicate_label(same, score).alias("label"), F.array_join(F.array_compact(reasons), "; ").alias("reasons"), action.alias("action"))


@query("SELECT c_custkey, lpad(coalesce(CASE WHEN c_custkey%4>0 THEN (c_custkey%1234)::VARCHAR END,''),3,'0') AS flags, substr(lpad(coalesce(CASE WHEN c_custkey%4>0 THEN (c_custkey%1234)::VARCHAR END,''),3,'0'),2,1) AS second FROM customer")
def padded_flags(spark, d):
    """Flags padded to three places (longer ones are cut), and the second of them."""
    raw = F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 1234).cast("string"))
    flags = F.lpad(F.coalesce(raw, F.lit("")), 3, "0")
    return T.table(spark, d, "customer").select("c_custkey", flags.alias("flags"), F.substring(flags, 2, 1).alias("second"))


@query("SELECT c_custkey, printf('%06d', c_custkey) AS six, CASE WHEN length((c_custkey*97)::VARCHAR)>=5 THEN (c_custkey*97)::VARCHAR ELSE lpad((c_custkey*97)::VARCHAR,5,'0') END AS five, concat_ws('_','M1',c_mktsegment,printf('%03d',c_nationkey)) AS route FROM customer")
def formatted_ids(spark, d):
    """Ids of at least six and five digits, never cut, and a route id of parts."""
    n = (F.col("c_custkey") * 97).cast("string")
    five = F.when(F.length(n) >= 5, n).otherwise(F.lpad(n, 5, "0"))
    return T.table(spark, d, "customer").select("c_custkey", F.format_string("%06d", "c_custkey").alias("six"), five.alias("five"), F.concat_ws("_", F.lit("M1"), "c_mktsegment", F.format_string("%03d", "c_nationkey")).alias("route"))


@query("SELECT customer_id, printf('%.6f,%.6f', lon, lat) AS coordinates, sha256(printf('%.6f,%.6f', lon, lat)) AS key FROM cust", "cust")
def coordinate_text(spark, d):
    """lon,lat with six decimals, and the key of a request made of it."""
    xy = F.format_string("%.6f,%.6f", "lon", "lat")
    return T.customers(spark, d).select("customer_id", xy.alias("coordinates"), F.sha2(xy, 256).alias("key"))


@query("SELECT p_partkey, replace(replace(replace(replace(replace(p_name || ' <&> ''' || p_brand || '\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM part")
def xml_escape(spark, d):
    raw = F.concat("p_name", F.lit(" <&> '"), "p_brand", F.lit('"'))
    return T.table(spark, d, "part").select("p_partkey", text.xml_escape(raw).alias("escaped"))


@query("SELECT s_suppkey, '{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\",\"nation\":' || s_nationkey || '}' AS json, sha256('{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\",\"nation\":' || s_nationkey || '}') AS sha FROM supplier")
def canonical_json(spark, d):
    """Objects with sorted keys and no spaces, and their hash."""
    j = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    return T.table(spark, d, "supplier").select("s_suppkey", j.alias("json"), F.sha2(j, 256).alias("sha"))


@query("SELECT n_nationkey, split_part(n_name || ' x', ' ', 1) AS first, starts_with(n_name, 'I') AS with_i, nullif(regexp_extract('valid from ' || (1990+n_nationkey) || '-01', '(\\d{4})', 1), '')::INT AS year FROM nation")
def token_parts(spark, d):
    """First word, prefix test, and the first four digits."""
    n = T.table(spark, d, "nation")
    year = F.regexp_extract(F.concat(F.lit("valid from "), 1990 + F.col("n_nationkey"), F.lit("-01")), r"(\d{4})", 1)
    return n.select("n_nationkey", F.split(F.concat("n_name", F.lit(" x")), " ")[0].alias("first"), F.col("n_name").startswith("I").alias("with_i"), F.nullif(year, F.lit("")).cast("int").alias("year"))


@query("SELECT c_custkey, (2900000000+c_custkey*1000+c_nationkey)%100000 AS section, (c_custkey%100)*1000+c_nationkey AS code, (c_custkey*1000+c_nationkey)//100 AS district FROM customer")
def census_codes(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return T.table(spark, d, "customer").select("c_custkey", ((F.lit(2900000000) + k * 1000 + n) % 100000).alias("section"), ((k % 100) * 1000 + n).alias("code"), F.floor((k * 1000 + n) / 100).alias("district"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 9 HOUR AS starts, o_orderdate + INTERVAL 9 HOUR + to_minutes(360 + o_orderkey%180) AS ends FROM orders")
def shift_window(spark, d):
    """A shift: a date, a start of day and a length in minutes."""
    start = F.col("o_orderdate") + F.expr("INTERVAL 9 HOURS")
    return T.table(spark, d, "orders").select("o_orderkey", start.alias("starts"), (start + F.make_dt_interval(mins=(360 + F.col("o_orderkey") % 180).cast("int"))).alias("ends"))


@query(
    """WITH h AS (SELECT c_custkey, c_custkey*37%360 AS hue FROM customer), s AS (SELECT *, hue/60.0 AS x FROM h), c AS (SELECT *, 0.85*0.7 AS chroma, 0.85-0.85*0.7 AS low, 0.85*0.7*(1-abs(x%2-1)) AS y FROM s)
SELECT c_custkey, hue, round(255*(low+CASE floor(x)::INT WHEN 0 THEN chroma WHEN 1 THEN y WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN y ELSE chroma END)::DOUBLE,6) AS red, round(255*(low+CASE floor(x)::INT WHEN 0 THEN y WHEN 1 THEN chroma WHEN 2 THEN chroma WHEN 3 THEN y ELSE 0 END)::DOUBLE,6) AS green,
round(255*(low+CASE floor(x)::INT WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN y WHEN 3 THEN chroma WHEN 4 THEN chroma ELSE y END)::DOUBLE,6) AS blue FROM c"""
)
def colour_rgb(spark, d):
    """Red, green and blue of a hue at saturation 0.7 and value 0.85."""
    x = T.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 360).alias("hue"))
    return x.select("c_custkey", "hue", *(F.round(c, 6).alias(n) for n, c in zip(("red", "green", "blue"), text.hsv_to_rgb(F.col("hue"), 0.7, 0.85), strict=True)))


@query("SELECT s_suppkey, CASE s_suppkey%4 WHEN 0 THEN 'Correos' WHEN 1 THEN 'SEUR' WHEN 2 THEN 'Mrw Express' END AS company, CASE WHEN s_suppkey%4=3 THEN 'missing' WHEN s_suppkey%4=2 THEN 'title' ELSE 'map' END AS found FROM supplier")
def value_map(spark, d):
    """Spellings of a company to its name by a map; unknown ones get capitals at each word."""
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, " correos  s.a. ").when(k == 1, "Seur").when(k == 2, "mrw express")
    known = {"CORREOS S A": "Correos", "CORREOS": "Correos", "SEUR": "SEUR"}
    value, found = text.canonical(raw, known)
    return T.table(spark, d, "supplier").select("s_suppkey", value.alias("company"), found.alias("found"))


@query("SELECT s_suppkey, '  ' || s_name || ' ' AS name_raw, s_name AS name, s_suppkey%3 AS kind_raw, upper('k' || s_suppkey%3) AS kind FROM supplier")
def raw_and_normal(spark, d):
    """Raw columns stay beside their normal form."""
    s = T.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("name_raw"), (F.col("s_suppkey") % 3).alias("kind_raw"))
    return s.select("s_suppkey", "name_raw", F.trim("name_raw").alias("name"), "kind_raw", F.upper(F.concat(F.lit("k"), F.col("kind_raw"))).alias("kind"))


@query("SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS id, c_custkey, c_name FROM customer")
def surrogate_id(spark, d):
    """1..n in the order of the names, without one task for all: counts of ranges first."""
    return resolution.numbered(T.table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"])


@query("SELECT facility_id, location FROM (SELECT f.facility_id, upper(left(n_name,3)) || '_LOC_' || lpad((dense_rank() OVER (PARTITION BY n_name ORDER BY g))::VARCHAR,6,'0') AS location FROM (SELECT *, min(facility_id) OVER (PARTITION BY company, lat, lon) AS g FROM fac) f JOIN nation ON n_nationkey=company)", "fac")
def cluster_numbering(spark, d):
    """Numbers of clusters within a city, in the order in which they first appear."""
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("company"), "n_name")
    f = T.facilities(spark, d).withColumn("g", F.min("facility_id").over(Window.partitionBy("company", "lat", "lon"))).join(n, "company")
    rank = F.dense_rank().over(Window.partitionBy("n_name").orderBy("g"))
    return f.select("facility_id", F.format_string("%s_LOC_%06d", F.upper(F.substring("n_name", 1, 3)), rank).alias("location"))
