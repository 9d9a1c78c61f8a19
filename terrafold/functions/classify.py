"""Ordered rules that name brands, classes, operators and bands (PRJ-1 to 5, 7, 8, 21-23, FLT-3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brands in the order in which they are tried: label, wikidata id, pattern.
BRANDS = (
    ("BSI (Bank Syariah Indonesia)", None, r"(bank syariah indonesia|(^|\W)bsi(\W|$))"),
    ("Agen BRILink", None, r"bri\s?link"),
    ("Alfamidi", None, r"alfa\s?midi"),
    ("Alfamart", "Q23745600", r"alfa\s?mart"),
    ("Indomaret", "Q4262825", r"indo\s?maret"),
    ("Lawson", None, r"(^|\W)lawson(\W|$)"),
    ("BCA", "Q806626", r"(^|\W)(bca|bank central asia)(\W|$)"),
    ("Bank Mandiri", "Q806639", r"(^|\W)mandiri(\W|$)"),
    ("BNI", "Q2882611", r"(^|\W)(bni|bank negara indonesia)(\W|$)"),
    ("BRI", "Q623042", r"(^|\W)(bri|bank rakyat indonesia)(\W|$)"),
)
#: Operators in the order in which they are tried.
OPERATORS = (
    ("IM3", r"indosat|\bim3\b|ooredoo|\bioh\b"),
    ("TSEL", r"telkomsel|\btsel\b|grapari|gerai\s*halo"),
    ("XL", r"\bxl\b|axiata|\baxis\b"),
    ("SF", r"smartfren|\bsf\b|smart\s*telecom"),
    ("3ID", r"\b3id\b|\btri\b|\b3\s?store\b|hutchison|\b3\s?kios\b"),
)
#: Classes of place by category, and what differs where intent or type comes from a paid search or map tags.
PLACE_CLASS = {
    "bank": ("bank", "banks", "bank_or_credit_union", "credit_union", "bank_credit_union", "commercial_bank", "savings_bank"),
    "atm": ("atm", "atms", "automated_teller_machine"),
    "rail": ("train_station", "trains", "metro_station", "light_rail_and_subway_stations", "railway_service", "subway_station"),
    "bus": ("bus_station", "bus_service", "bus_stop", "transit_station", "public_transportation"),
    "retail": ("convenience_store", "supermarket", "grocery_store"),
    "fuel": ("gas_station",),
    "mall": ("shopping_mall", "department_store"),
    "gov": ("local_government_office", "government_office"),
    "industry": ("manufacturer", "supplier"),
}
SEARCH_TARGET_CLASS = {
    "retail": ("alfamart", "indomaret", "alfamidi", "stores_other"),
    "mall": ("malls",),
    "atm": ("atms",),
    "bank": ("bank_branches", "bank_hq"),
    "agent": ("brilink",),
    "gov": ("gov_kelurahan", "gov_kecamatan", "gov_kabkot", "gov_provinsi"),
    "industry": ("pabrik", "factory_typed", "industrial", "manufacturer", "industrial_estates"),
}
SEARCH_TYPE_CLASS = {
    "bank": ("bank",),
    "atm": ("atm",),
    "rail": ("train_station", "subway_station", "light_rail_station", "transit_station"),
    "bus": ("bus_station", "bus_stop"),
    "retail": ("convenience_store", "supermarket", "grocery_store", "asian_grocery_store", "discount_supermarket", "hypermarket", "store"),
    "fuel": ("gas_station",),
    "gov": ("local_government_office", "city_hall", "government_office", "courthouse", "post_office"),
    "industry": ("manufacturer", "supplier", "wholesaler", "storage"),
    "mall": ("shopping_mall", "department_store"),
}
MAP_TARGET_CLASS = {
    "rail": ("rail_stations",),
    "bus": ("bus_stops", "bus_terminals"),
    "bank": ("bank_branches",),
    "atm": ("atms",),
    "retail": ("minimarkets",),
    "fuel": ("fuel_stations",),
}
MAP_TAG_CLASS = {
    "bank": ("amenity=bank",),
    "atm": ("amenity=atm",),
    "fuel": ("amenity=fuel",),
    "bus": ("amenity=bus_station", "highway=bus_stop", "public_transport=platform", "public_transport=station"),
    "rail": ("railway=station", "railway=halt", "station=subway", "station=light_rail"),
    "retail": ("shop=convenience", "shop=supermarket"),
    "mall": ("shop=mall", "shop=department_store"),
    "gov": ("amenity=townhall", "office=government"),
    "industry": ("man_made=works", "landuse=industrial"),
}
#: Regencies and cities that count as urban.
URBAN = ("JAKARTA PUSAT", "JAKARTA UTARA", "JAKARTA BARAT", "JAKARTA SELATAN", "JAKARTA TIMUR", "KOTA DEPOK", "DEPOK", "KOTA BEKASI")


def _first(cases: Sequence[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for test, label in reversed(cases):
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def matches(text: Column, pattern: str) -> Column:
    """Whether a lower-case text has the pattern; false for null."""
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


def brand(name: Column, brand_text: Column | None = None, wikidata: Column | None = None) -> Column:
    """The first brand that any of the fields tells (PRJ-1, PRJ-3): brand by brand."""
    fields = [c for c in (brand_text, name) if c is not None]
    cases = []
    for label, qid, pattern in BRANDS:
        test = F.lit(False)
        if wikidata is not None and qid:
            test = F.coalesce(wikidata == qid, F.lit(False))
        for c in fields:
            test = test | matches(c, pattern)
        cases.append((test, label))
    return _first(cases)


def brand_by_field(wikidata: Column, *fields: Column) -> Column:
    """The other order (PRJ-2): the id first, then each field through all brands."""
    by_id = _first([(wikidata == qid, label) for label, qid, _ in BRANDS if qid])
    return F.coalesce(by_id, *[_first([(matches(c, p), label) for label, _, p in BRANDS]) for c in fields])


def by_table(value: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """The class whose words hold the value, or null."""
    return _first([(F.coalesce(value.isin(*words), F.lit(False)), label) for label, words in table.items()])


def place_class(source: Column, category: Column, target: Column) -> Column:
    """Class of a point of interest by its source's tables; targets are told before types (PRJ-4)."""
    return (
        F.when(source == "overture", by_table(category, PLACE_CLASS))
        .when(source == "google", F.coalesce(by_table(target, SEARCH_TARGET_CLASS), by_table(category, SEARCH_TYPE_CLASS)))
        .when(source == "osm", F.coalesce(by_table(target, MAP_TARGET_CLASS), by_table(category, MAP_TAG_CLASS)))
    )


def dot_class(category: Column, exact: Mapping[str, str], parts: Sequence[tuple[str, str]], other: str = "poi_other") -> Column:
    """A map dot's class: the exact category, else the first rule whose text it contains (PRJ-5)."""
    told = [(category == k, v) for k, v in exact.items()] + [(F.contains(category, F.lit(k)), v) for k, v in parts]
    return F.coalesce(_first(told), F.lit(other))


#: How folders and names of phone shops' counters read.
COUNTER_FOLDER = r"\bipp\b|konter|\bcounter\b|pulsa"
COUNTER_NAME = r"\bcell\b|\bcel\b|\bponsel\b|\bselular\b|\bseluler\b|konter"


def operator(*texts: Column) -> Column:
    """Operator of a service point from all its texts."""
    text = F.lower(F.concat_ws(" ", *texts))
    return F.coalesce(_first([(text.rlike(p), k) for k, p in OPERATORS]), F.lit("OTHER"))


def service_point(raw: Column, folder: Column, name: Column, kind: Column) -> tuple[Column, Column]:
    """Operator and class of a service point (PRJ-7): a counter's folder tells it at once, a counter's name only
    where no operator is named; counters are IPP outlets."""
    by_text = operator(raw, folder, name, kind)
    counter = matches(folder, COUNTER_FOLDER) | ((by_text == "OTHER") & matches(name, COUNTER_NAME))
    return F.when(counter, "IPP").otherwise(by_text), F.when(counter, "outlet").when(by_text == "OTHER", "unknown").otherwise("operator")


def density(population: Column, area_km2: Column) -> Column:
    """People per square kilometre to whole numbers; null if it can't be told (PRJ-8)."""
    return F.when((area_km2 > 0) & population.isNotNull(), F.floor(population / area_km2 + 0.5))


def hierarchy(*names: Column) -> Column:
    """Names from the top down, blanks left out (PRJ-8)."""
    joined = F.concat_ws(" › ", *[F.when(F.trim(n) != "", F.trim(n)) for n in names])
    return F.when(joined != "", joined)


def stratum(kabkot: Column) -> Column:
    """urban or rural by the list of cities (PRJ-21)."""
    return F.when(F.upper(F.trim(F.coalesce(kabkot, F.lit("")))).isin(*URBAN), "urban").otherwise("rural")


def stratum_by_density(per_km2: Column, least: float = 1500.0) -> Column:
    return F.when(per_km2 >= least, "urban").otherwise("rural")


def band(value: Column, breaks: Sequence[float]) -> Column:
    """How many of the ascending breaks a value has reached (PRJ-23)."""
    out = F.lit(len(breaks))
    for k, b in reversed(list(enumerate(breaks))):
        out = F.when(value < b, k).otherwise(out)
    return F.when(value.isNotNull(), out)


def golden_hue(index: Column) -> Column:
    """Hues of a series that stay apart (PRJ-22)."""
    return F.pmod(index * 137.508, F.lit(360.0))


def hex_colour(hue: Column, saturation: float = 0.62, lightness: float = 0.55) -> Column:
    """#rrggbb of a hue."""
    chroma = (1 - abs(2 * lightness - 1)) * saturation
    low = lightness - chroma / 2

    def channel(shift: float) -> Column:
        k = F.pmod(hue / 60.0 + shift, F.lit(6.0))
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(k - 3.0) - 1.0))
        return F.lpad(F.lower(F.hex(F.floor((part * chroma + low) * 255 + 0.5).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0.0), channel(4.0), channel(2.0))


def wanted(name: Column, category: Column, confidence: Column, open_status: Column, brand_label: Column, categories: Sequence[str], name_any: str | None = None, name_not: str | None = None, least_confidence: float = 0.0, brand_required: bool = False) -> Column:
    """Whether a place belongs to a target (FLT-3): by category, or rescued by its name, unless its name
    forbids it; sure enough; not closed; of a known brand where one is asked for."""
    test = F.coalesce(category.isin(*categories), F.lit(False))
    if name_any:
        test = test | matches(F.coalesce(name, F.lit("")), name_any)
    if name_not:
        test = test & ~matches(F.coalesce(name, F.lit("")), name_not)
    test = test & (F.coalesce(confidence, F.lit(0.0)) >= least_confidence) & (F.coalesce(open_status, F.lit("open")) == "open")
    return test & brand_label.isNotNull() if brand_required else test
