"""Reading the files that territories come in (SRC-1, 3 to 6, 8, 13, 15 to 17, 19, 20, 26 to 29, 31)."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrafold.functions import classify
from terrafold.functions.geo import DEGREE_M, ENVELOPE, haversine_m, repaired
from terrafold.functions.text import header_key, number_with_decimal_comma

SEPARATORS = ",;\t|"


def separator(line: str) -> str:
    """The separator that cuts a header line most often, outside quotes (SRC-29)."""
    return max(SEPARATORS, key=lambda s: (len(next(csv.reader(io.StringIO(line), delimiter=s), [])), -SEPARATORS.index(s)))


def read_table(spark: SparkSession, path: str, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """A delimited file with columns named by header synonyms (SRC-20, SRC-29); unknown columns keep their names."""
    head = spark.read.text(path).first()
    rows = spark.read.csv(path, header=True, sep=separator(head[0]) if head else ",", quote='"', escape='"')
    known = {alias: name for name, aliases in synonyms.items() for alias in aliases}
    keys = spark.createDataFrame([(c,) for c in rows.columns], "c string").select("c", header_key(F.col("c")).alias("k")).collect()
    names, taken = [], set()
    for r in keys:
        name = known.get(r.k, r.c)
        names.append(name if name not in taken else r.c)
        taken.add(names[-1])
    return rows.toDF(*names)


#: Rows among which a header is sought.
HEADER_ROWS = 12


def read_loose(spark: SparkSession, path: str, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """A delimited file whose header stands among its first ``HEADER_ROWS`` lines, or nowhere (SRC-20, SRC-30).

    The header is the first of the lines with the most known names; what stands before it is left out, and unknown columns
    keep their names. Where no line has a known name, columns are told by what they hold, in one pass over all lines:
    ``lat`` and ``lon`` are the columns whose values lie in the map's envelope most often (never seldom), ``name`` is the
    first one that holds words mostly; others are ``c0`` and so on. Blank lines are no rows.
    """
    head = [r.value for r in spark.read.text(path).limit(HEADER_ROWS).collect()]
    sep = separator(max(head, key=lambda line: max(len(next(csv.reader(io.StringIO(line), delimiter=s), [])) for s in SEPARATORS), default=""))
    cells = [next(csv.reader(io.StringIO(line), delimiter=sep), []) for line in head]
    known = {alias: name for name, aliases in synonyms.items() for alias in aliases}
    told = [(i, k, c) for i, row in enumerate(cells) for k, c in enumerate(row)]
    keys = spark.createDataFrame(told or [(0, 0, "")], "i int, k int, c string").select("i", "k", header_key(F.col("c")).alias("key")).collect()
    score = [len({known[r.key] for r in keys if r.i == i and r.key in known}) for i in range(len(cells))]
    at = score.index(max(score)) if any(score) else -1
    width = max(map(len, cells[at : at + 1] if at >= 0 else cells), default=0) or 1
    names = [f"c{k}" for k in range(width)]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    # the first lines are those of the block that begins the file, which is the first one in its partition
    lines = spark.read.text(path).select("value", place.alias("n"), (F.col("_metadata.file_block_start") == 0).alias("first"))
    lines = lines.where((~F.col("first") | (F.col("n") > at)) & (F.trim("value") != ""))
    rows = lines.select(F.from_csv("value", ", ".join(f"{c} string" for c in names), {"sep": sep, "quote": '"', "escape": '"'}).alias("r")).select("r.*")
    if at >= 0:
        keyed = {r.k: known.get(r.key) for r in keys if r.i == at}
        new, taken = [], set()
        for k, c in enumerate(cells[at]):
            name = keyed.get(k) if keyed.get(k) not in taken else None
            new.append(name or (c if c and c not in taken and c not in synonyms else f"c{k}"))
            taken.add(new[-1])
        return rows.toDF(*new)
    number = lambda c: number_with_decimal_comma(F.col(c))
    within = lambda c, what: F.count_if(number(c).between(*ENVELOPE[what]))
    found = rows.agg(*[f for c in names for f in (F.count_if(F.trim(c) != "").alias(f"{c}_n"), F.count_if(number(c).isNotNull()).alias(f"{c}_num"), within(c, "lat").alias(f"{c}_lat"), within(c, "lon").alias(f"{c}_lon"))]).first()
    best = {what: max((c for c in names if 2 * found[f"{c}_{what}"] > found[f"{c}_n"]), key=lambda c: found[f"{c}_{what}"], default=None) for what in ("lat", "lon")}
    words = next((c for c in names if 2 * found[f"{c}_num"] < found[f"{c}_n"]), None)
    of = {c: what for what, c in [*best.items(), ("name", words)] if c is not None}
    return rows.toDF(*[of.get(c, c) for c in names])


def with_positions(rows: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Latitude and longitude as numbers, decimal commas read and swapped pairs repaired; ``reject`` says why a row
    can't be placed (SRC-26, SRC-27)."""
    a, b = repaired(number_with_decimal_comma(F.col(lat)), number_with_decimal_comma(F.col(lon)))
    rows = rows.withColumns({lat: a, lon: b})
    return rows.withColumn("reject", F.when(F.col(lat).isNull() | F.col(lon).isNull(), "no_coords").when((F.abs(lat) > 90) | (F.abs(lon) > 180), "off_map"))


_FEATURE = "properties map<string,string>, geometry struct<type:string,coordinates:string>"


def _features(rows: DataFrame) -> DataFrame:
    """Features ``f`` as ``name``, ``attrs``, ``polys``."""
    poly, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    coordinates = F.col("f.geometry.coordinates")
    polys = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(coordinates, poly))).when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(coordinates, many))
    return rows.select(F.coalesce(F.col("f.properties")["name"], F.col("f.properties")["NAME"]).alias("name"), F.col("f.properties").alias("attrs"), polys.alias("polys"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a collection: ``name``, ``attrs``, ``polys`` (SRC-28). A file is one task, whatever its form."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    return _features(spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f")))


def read_large_geojson(spark: SparkSession, path: str, mark: str = '{"type":"Feature",') -> DataFrame:
    """The same of collections of any size, a file by many tasks (SRC-28).

    ``mark`` is how each feature begins, to the letter; files are cut there, wherever a task's bytes begin, and what follows
    a feature, a comma or the collection's end, is left to the parser to ignore. In a text it can't stand, as quotes are
    escaped there.
    """
    pieces = spark.read.text(path, lineSep=mark).select("value", (F.col("_metadata.file_block_start") == 0).alias("begins"))
    # what comes before the first mark is no feature; nothing else begins like it
    told = pieces.where(~F.coalesce(F.rlike(F.ltrim("value"), F.lit(r'^\{\s*"type"\s*:\s*"FeatureCollection"')) & F.col("begins"), F.lit(False)))
    return _features(told.select(F.from_json(F.concat(F.lit(mark), "value"), _FEATURE).alias("f")).where("f.geometry IS NOT NULL OR f.properties IS NOT NULL"))


def map_elements(elements: DataFrame, tags_in_order: Sequence[str] = ("amenity", "shop", "railway", "highway", "public_transport", "office")) -> DataFrame:
    """Elements of a map extract as places; those without a position are left out (SRC-8)."""
    category = F.lit(None).cast("string")
    for tag in reversed(tags_in_order):
        category = F.when(F.col("tags")[tag].isNotNull(), F.concat(F.lit(f"{tag}="), F.col("tags")[tag])).otherwise(category)
    rows = elements.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("place_id"), F.col("tags")["name"].alias("name"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), category.alias("category"), "tags")
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL")


def overpass_query(selectors: Sequence[str], box: tuple[float, float, float, float], timeout: int = 180) -> str:
    """A query for elements in (south, west, north, east) (SRC-6)."""
    area = ",".join(f"{x:g}" for x in box)
    return f"[out:json][timeout:{timeout}];\n(\n" + "".join(f"  nwr{s}({area});\n" for s in selectors) + ");\nout center meta;"


def within_box(places: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Places of a nested table by bounding-box statistics that the scan can skip row groups by (SRC-1, SRC-3)."""
    south, west, north, east = box
    return places.where(F.col("bbox.xmin").between(west, east) & F.col("bbox.ymin").between(south, north))


def places_table(places: DataFrame) -> DataFrame:
    """Flat columns of nested places; columns that a release lacks are null (SRC-1, SRC-5)."""
    have = set(places.columns)
    taxonomy = F.col("taxonomy.primary") if "taxonomy" in have else F.col("categories.primary") if "categories" in have else F.lit(None).cast("string")
    basic = F.col("basic_category") if "basic_category" in have else F.lit(None).cast("string")
    status = F.col("operating_status") if "operating_status" in have else F.lit(None).cast("string")
    return places.select("id", F.col("names.primary").alias("name"), taxonomy.alias("category"), basic.alias("basic_category"), status.alias("status"), F.get("addresses", 0)["freeform"].alias("address"), ((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2).alias("lon"), ((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2).alias("lat"), "confidence")


def target_places(places: DataFrame, box: tuple[float, float, float, float], categories: Sequence[str], **rule) -> DataFrame:
    """Places of a target in a box (SRC-3): the box on the scan, then the target's rule (see ``classify.wanted``), with the brand that the
    name tells and positions of seven digits."""
    rows = places_table(within_box(places, box)).withColumn("brand", classify.brand(F.col("name")))
    rows = rows.where(classify.wanted(F.col("name"), F.col("category"), F.col("confidence"), F.col("status"), F.col("brand"), categories, **rule))
    return rows.withColumns({c: F.round(c, 7) for c in ("lat", "lon")})


def around(places: DataFrame, lat: float, lon: float, metres: float, most: int) -> DataFrame:
    """The nearest places within a distance (SRC-4): a range that reaches the scan, then the exact distance."""
    d = metres / DEGREE_M
    box = F.col("lat").between(lat - d, lat + d) & F.col("lon").between(lon - 2 * d, lon + 2 * d)
    rows = places.where(box).withColumn("metres", haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
    return rows.where(F.col("metres") <= metres).orderBy("metres", "point_id").limit(most)


def tiles(boxes: DataFrame, tile_km: float) -> DataFrame:
    """Circles that cover boxes (``box``, ``south``, ``west``, ``north``, ``east``), each around a square tile (SRC-13, SRC-14)."""
    high = tile_km * 1000 / DEGREE_M
    wide = F.lit(high) / F.cos(F.radians((F.col("south") + F.col("north")) / 2))
    rows = boxes.withColumn("wide", wide)
    count = lambda span, step: F.greatest(F.lit(1), F.ceil(span / step)).cast("int") - 1
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), count(F.col("east") - F.col("west"), F.col("wide"))))).withColumn("j", F.explode(F.sequence(F.lit(0), count(F.col("north") - F.col("south"), F.lit(high)))))
    return rows.select("box", (F.col("west") + (F.col("i") + 0.5) * F.col("wide")).alias("lon"), (F.col("south") + (F.col("j") + 0.5) * high).alias("lat"), F.lit(tile_km * 1000 * 2**0.5 / 2).alias("metres"))


def request_plan(searches: DataFrame, price: float, budget: float) -> DataFrame:
    """Calls and cost of searches (``target``, ``cells``, ``pages_low``, ``pages_high``), and whether the budget holds (SRC-15)."""
    rows = searches.withColumns({"low": F.col("cells") * F.col("pages_low"), "high": F.col("cells") * F.col("pages_high")})
    total = rows.agg(F.sum("low").alias("calls_low"), F.sum("high").alias("calls_high"))
    return total.withColumns({"cost_low": F.col("calls_low") * price, "cost_high": F.col("calls_high") * price, "fits": F.col("calls_high") * price <= budget})


def file_role(name: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """What a file is, by the first text that its name contains (SRC-31)."""
    out = F.lit(other)
    for text, role in reversed(rules):
        out = F.when(F.contains(F.lower(name), F.lit(text)), role).otherwise(out)
    return out


# files that are parsed record by record


_ROW, _FIELD = re.compile(r"<tr\b.*?</tr>", re.I | re.S), re.compile(r"<t[dh]\b[^>]*>(.*?)</t[dh]>", re.I | re.S)


def _told(description: str) -> dict[str, str]:
    """Attributes in the rows of an HTML table that have a name and a value."""
    plain = lambda t: html.unescape(re.sub("<[^>]*>", " ", t)).strip()
    rows = ([plain(c) for c in _FIELD.findall(r)] for r in _ROW.findall(description))
    return {r[0]: r[1] for r in rows if len(r) == 2 and r[0]}


def _placemarks(stream) -> Iterator[tuple]:
    """name, folder, attributes, polygons, points and lines of placemarks, dropping each element once it is read (SRC-16, SRC-17)."""
    local = lambda e: e.tag.rpartition("}")[2]
    folders: list[str | None] = []
    stack = []
    for event, e in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            stack.append(e)
            if local(e) == "Folder":
                folders.append(None)
            continue
        stack.pop()
        if local(e) == "name" and stack and local(stack[-1]) == "Folder" and folders:
            folders[-1] = e.text
        elif local(e) == "Folder":
            folders.pop()
        if local(e) != "Placemark":
            continue
        attrs, polys, points, lines, name = {}, [], [], [], None
        spots = lambda c: [[float(n) for n in p.split(",")[:2]] for p in (c.text or "").split()]
        for x in e.iter():
            if local(x) == "name" and name is None:
                name = x.text
            elif local(x) == "description":
                attrs = _told(x.text or "") | attrs
            elif local(x) == "SimpleData":
                attrs[x.get("name")] = x.text
            elif local(x) == "Data":
                attrs[x.get("name")] = next((v.text for v in x if local(v) == "value"), None)
            elif local(x) == "Polygon":
                polys.append([spots(c) for c in x.iter() if local(c) == "coordinates"])
            elif local(x) in ("Point", "LineString"):
                for c in x:
                    if local(c) == "coordinates" and local(x) == "Point":
                        points += spots(c)
                    elif local(c) == "coordinates":
                        lines.append(spots(c))
        blank = ("", "#N/A", "-", "NULL", "N/A")
        yield name, "/".join(f or "" for f in folders), {k: v.strip() for k, v in attrs.items() if k and v and v.strip().upper() not in blank}, polys, points, lines
        e.clear()
        if stack:
            stack[-1].remove(e)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _KmlReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as file:
            if file.read(2) == b"PK":
                file.seek(0)
                packed = zipfile.ZipFile(file)
                inner = next(n for n in packed.namelist() if n.lower().endswith(".kml"))
                yield from _placemarks(packed.open(inner))
            else:
                file.seek(0)
                yield from _placemarks(file)


class KmlSource(DataSource):
    """KML and KMZ files, a partition each, parsed in constant memory (SRC-16, SRC-17, SRC-25).

    Register with ``spark.dataSource.register(KmlSource)``; ``paths`` are comma-separated shared paths.
    """

    @classmethod
    def name(cls):
        return "kml"

    def schema(self):
        return "name string, folder string, attrs map<string,string>, polys array<array<array<array<double>>>>, points array<array<double>>, lines array<array<array<double>>>"

    def reader(self, schema):
        return _KmlReader(self.options["paths"].split(","))


def _sheet_rows(path: str, need: Sequence[str]) -> Iterator[tuple[str, dict]]:
    """Rows of the first sheet with a header row that has the needed columns, found in its first twelve rows (SRC-19)."""
    with zipfile.ZipFile(path) as book:
        names = book.namelist()
        tag = lambda e: e.tag.rpartition("}")[2]
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot():
                shared.append("".join(t.text or "" for t in item.iter() if tag(t) == "t"))
        for sheet in sorted(n for n in names if n.startswith("xl/worksheets/sheet")):
            head = None
            count = 0
            for _, e in ElementTree.iterparse(book.open(sheet)):
                if tag(e) != "row":
                    continue
                cells = {}
                for c in e:
                    text = "".join(x.text or "" for x in c.iter() if tag(x) in ("v", "t"))
                    cells["".join(filter(str.isalpha, c.get("r", "")))] = shared[int(text)] if c.get("t") == "s" and text else text
                count += 1
                if head is None:
                    if set(need) <= {str(v).strip() for v in cells.values()}:
                        head = {k: str(v).strip() for k, v in cells.items() if v}
                    elif count >= 12:
                        break
                elif any(cells.values()):
                    yield sheet, {head[k]: v for k, v in cells.items() if k in head and v != ""}
                e.clear()
            if head is not None:
                return


class _SheetReader(_KmlReader):
    def __init__(self, paths: list[str], need: list[str]):
        super().__init__(paths)
        self.need = need

    def read(self, partition):
        yield from _sheet_rows(partition.path, self.need)


class SheetSource(DataSource):
    """Workbooks as rows of ``sheet`` and ``cells`` by header (SRC-19, SRC-21 to 24); options ``paths`` and ``columns``."""

    @classmethod
    def name(cls):
        return "sheets"

    def schema(self):
        return "sheet string, cells map<string,string>"

    def reader(self, schema):
        return _SheetReader(self.options["paths"].split(","), self.options.get("columns", "").split(",") if self.options.get("columns") else [])
