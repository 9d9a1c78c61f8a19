"""License scans: ordered signature rules over normalised words.

A text is scanned only if a keyword occurs in it; each rule then only if its own keyword does. Rules
are regular expressions over the text's lower-case words joined by spaces, each with a label, a
priority and a score. Of overlapping detections, one that lies within a longer one is suppressed,
and of equal spans the highest priority stays (of equal priorities the smallest label). Of those that
are left and overlap partly, the lower priority goes; with equal priorities both stay. The mentions
of the base phrases are counted apart from that, and their labels always stay.

All of it is built-in functions on one row: nothing is shuffled.

Defined results: null and empty texts have no words, no labels (empty strings) and score 0. The
score is that of the strongest detection left. Equal rows get equal results. Only the named columns are read; ``carry`` columns
are handed on whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licenses by label: a word that every mention has, and how they are named, in lower-case words.
FAMILIES = {
    "gpl-1.0": ("general public", r"(?:gnu )?general public licen[cs]e (?:v ?|version )?1(?: 0)?"),
    "gpl-2.0": ("general public", r"(?:gnu )?general public licen[cs]e (?:v ?|version )?2(?: 0)?"),
    "gpl-3.0": ("general public", r"(?:gnu )?general public licen[cs]e (?:v ?|version )?3(?: 0)?"),
    "gpl-2.0-short": ("gpl", r"(?:gnu )?gpl ?(?:v ?|version )?2(?: 0)?"),
    "gpl-3.0-short": ("gpl", r"(?:gnu )?gpl ?(?:v ?|version )?3(?: 0)?"),
    "lgpl": ("lesser general public", r"(?:gnu )?lesser general public licen[cs]e"),
    "lgpl-2.1": ("lesser general public", r"(?:gnu )?lesser general public licen[cs]e (?:v ?|version )?2 1"),
    "lgpl-3.0": ("lesser general public", r"(?:gnu )?lesser general public licen[cs]e (?:v ?|version )?3(?: 0)?"),
    "lgpl-2.0": ("library general public", r"(?:gnu )?library general public licen[cs]e"),
    "agpl-3.0": ("affero general public", r"(?:gnu )?affero general public licen[cs]e(?: (?:v ?|version )?3(?: 0)?)?"),
    "gfdl": ("free documentation", r"(?:gnu )?free documentation licen[cs]e"),
    "apache-1.0": ("apache", r"apache (?:software )?licen[cs]e (?:v ?|version )?1 0"),
    "apache-1.1": ("apache", r"apache (?:software )?licen[cs]e (?:v ?|version )?1 1"),
    "apache-2.0": ("apache", r"apache (?:software )?licen[cs]e (?:v ?|version )?2(?: 0)?"),
    "mit": ("mit", r"mit (?:x11 )?licen[cs]e"),
    "mit-0": ("mit", r"mit no attribution(?: licen[cs]e)?"),
    "expat": ("expat", r"expat licen[cs]e"),
    "x11": ("x11", r"x11 licen[cs]e"),
    "bsd": ("bsd", r"bsd (?:style )?licen[cs]e"),
    "bsd-2-clause": ("bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    "bsd-3-clause": ("bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[cs]e)?"),
    "bsd-4-clause": ("bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    "0bsd": ("bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?"),
    "isc": ("isc", r"isc licen[cs]e"),
    "zlib": ("zlib", r"zlib(?: libpng)? licen[cs]e"),
    "libpng": ("libpng", r"libpng licen[cs]e"),
    "boost-1.0": ("boost", r"boost software licen[cs]e(?: (?:v ?|version )?1 0)?"),
    "mpl-1.0": ("mozilla public", r"mozilla public licen[cs]e (?:v ?|version )?1 0"),
    "mpl-1.1": ("mozilla public", r"mozilla public licen[cs]e (?:v ?|version )?1 1"),
    "mpl-2.0": ("mozilla public", r"mozilla public licen[cs]e(?: (?:v ?|version )?2(?: 0)?)?"),
    "epl-1.0": ("eclipse public", r"eclipse public licen[cs]e (?:v ?|version )?1(?: 0)?"),
    "epl-2.0": ("eclipse public", r"eclipse public licen[cs]e (?:v ?|version )?2(?: 0)?"),
    "cpl-1.0": ("common public", r"common public licen[cs]e(?: (?:v ?|version )?1 0)?"),
    "ipl-1.0": ("ibm public", r"ibm public licen[cs]e(?: (?:v ?|version )?1 0)?"),
    "cddl-1.0": ("common development and distribution", r"common development and distribution licen[cs]e(?: (?:v ?|version )?1 0)?"),
    "eupl-1.2": ("european union public", r"european union public licen[cs]e(?: (?:v ?|version )?1 2)?"),
    "artistic-1.0": ("artistic", r"artistic licen[cs]e (?:v ?|version )?1 0"),
    "artistic-2.0": ("artistic", r"artistic licen[cs]e(?: (?:v ?|version )?2 0)?"),
    "python-2.0": ("python software foundation", r"python software foundation licen[cs]e(?: (?:v ?|version )?2(?: 0)?)?"),
    "php-3.01": ("php", r"php licen[cs]e(?: (?:v ?|version )?3 01)?"),
    "ruby": ("ruby", r"ruby licen[cs]e"),
    "perl": ("perl", r"same terms as perl(?: itself)?"),
    "postgresql": ("postgresql", r"postgresql licen[cs]e"),
    "openssl": ("openssl", r"openssl licen[cs]e"),
    "openldap": ("openldap", r"openldap public licen[cs]e"),
    "ofl-1.1": ("open font", r"(?:sil )?open font licen[cs]e(?: (?:v ?|version )?1 1)?"),
    "odbl-1.0": ("open database", r"open database licen[cs]e(?: (?:v ?|version )?1 0)?"),
    "odc-by": ("open data commons attribution", r"open data commons attribution licen[cs]e"),
    "pddl": ("public domain dedication", r"public domain dedication(?: and licen[cs]e)?"),
    "ms-pl": ("microsoft public", r"microsoft public licen[cs]e"),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    "upl-1.0": ("universal permissive", r"universal permissive licen[cs]e(?: (?:v ?|version )?1 0)?"),
    "wtfpl": ("wtfpl", r"wtfpl"),
    "unlicense": ("unlicense", r"(?:the )?unlicense"),
    "cc0-1.0": ("cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    "cc-by": ("cc by", r"cc by(?: [1-4] [05])?"),
    "cc-by-sa": ("cc by sa", r"cc by sa(?: [1-4] [05])?"),
    "cc-by-nd": ("cc by nd", r"cc by nd(?: [1-4] [05])?"),
    "cc-by-nc": ("cc by nc", r"cc by nc(?: [1-4] [05])?"),
    "cc-by-nc-sa": ("cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    "cc-by-nc-nd": ("cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    "cc-attribution": ("creative commons attribution", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)? licen[cs]e"),
    "cc-attribution-sharealike": ("creative commons attribution", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
    "cc-attribution-noncommercial": ("creative commons attribution", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
    "public-domain": ("public domain", r"(?:released|placed|dedicated) (?:in)?to the public domain"),
    "all-rights-reserved": ("all rights reserved", r"all rights reserved"),
    "proprietary": ("proprietary", r"proprietary and confidential"),
}

#: How a license is mentioned: rule name, pattern around the license's name, priority, score.
MENTIONS = (
    ("identifier", r"spdx license identifier {}", 40, 1.0),
    ("grant", r"(?:licensed|released|distributed|available|published|covered|provided|shared) under (?:the )?(?:terms of )?(?:the )?{}", 30, 0.95),
    ("named", r"{}", 20, 0.8),
)

#: Identifiers of the SPDX list; versions of the GNU licenses may be followed by ``only`` or ``or later``.
SPDX = """0BSD AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause
BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPL-1.0
ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU IJG IPL-1.0 ISC LGPL-2.0 LGPL-2.1
LGPL-3.0 Libpng LPPL-1.3c MIT MIT-0 MIT-CMU MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0
ODC-By-1.0 OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-DFS-2016
Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split() + [f"CC-BY{kind}-{v}" for kind in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]

#: Labels of identifiers whose license has another name among the families.
_RENAMED = {"bsl-1.0": "boost-1.0", "odc-by-1.0": "odc-by", "pddl-1.0": "pddl", "oldap-2.8": "openldap", "psf-2.0": "python-2.0", "mpl-2.0-no-copyleft-exception": "mpl-2.0"}

_VERSION = r" ?(?:v ?|version )?{}"
#: Short names that tell a license by themselves: label, keyword and pattern.
SHORT = tuple(
    (f"{name}-{v}", name, rf"(?:gnu )?{name}" + _VERSION.format(v.replace(".", " ") if not v.endswith(".0") else rf"{v[0]}(?: 0)?"))
    for name, versions in {"lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"), "mpl": ("1.0", "1.1", "2.0"), "epl": ("1.0", "2.0"), "cddl": ("1.0", "1.1"), "eupl": ("1.1", "1.2"), "ofl": ("1.0", "1.1"), "gpl": ("1.0", "2.0", "3.0")}.items()
    for v in versions
) + (("gpl", " gpl ", r"(?:gnu )?gpl"), ("lgpl", " lgpl ", r"(?:gnu )?lgpl"), ("agpl", " agpl ", r"(?:gnu )?agpl"), ("gfdl", " gfdl ", r"(?:gnu )?gfdl"), ("cddl-1.0", " cddl ", "cddl"), ("eupl", " eupl ", "eupl"))
#: Short names that count only beside words of licensing, as they mean other things, too.
BESIDE = (
    ("mit", " mit ", "mit"),
    ("expat", " expat ", "expat"),
    ("isc", " isc ", "isc"),
    ("zlib", " zlib ", "zlib(?: libpng)?"),
    ("bsd", " bsd ", "bsd(?! [1-4] clause)"),
    ("unlicense", " unlicense ", "unlicense"),
    ("apache-1.1", " apache", "apache" + _VERSION.format("1 1")),
    ("apache-2.0", " apache", "apache" + _VERSION.format("2(?: 0)?")),
    ("apache-2.0", " asl", "asl" + _VERSION.format("2(?: 0)?")),
    ("boost-1.0", " bsl ", "bsl 1 0"),
    ("boost-1.0", " boost ", "boost(?: 1 0)?"),
    ("mpl", " mpl ", "mpl"),
    ("epl", " epl ", "epl"),
    ("ofl-1.1", " ofl ", "(?:sil )?ofl"),
)

#: Names of Creative Commons licenses in words, and short names of the Affero and Lesser ones.
SHORT += tuple((f"cc-by{kind.replace(' ', '-')}", f"creative commons by{kind} ", rf"creative commons by{kind}(?: [1-4] [05])?") for kind in ("", " sa", " nd", " nc", " nc sa", " nc nd"))
SHORT += (("agpl", " affero gpl ", "(?:gnu )?affero gpl"), ("agpl-3.0", " affero gpl ", "(?:gnu )?affero gpl" + _VERSION.format("3(?: 0)?")), ("lgpl", " lesser gpl ", "(?:gnu )?lesser gpl"), ("lgpl-2.1", " lesser gpl ", "(?:gnu )?lesser gpl" + _VERSION.format("2 1")), ("lgpl-3.0", " lesser gpl ", "(?:gnu )?lesser gpl" + _VERSION.format("3(?: 0)?")))
#: Addresses of license texts, as words: label and pattern; each has `` org ``.
LINKS = (
    *((f"cc-by{kind.replace(' ', '-')}", f"creativecommons org licenses by{kind}(?: [1-4] [05])?") for kind in ("", " sa", " nd", " nc", " nc sa", " nc nd")),
    ("cc0-1.0", "creativecommons org publicdomain zero(?: 1 0)?"),
    ("public-domain", "creativecommons org publicdomain mark(?: 1 0)?"),
    ("apache-1.0", "apache org licenses license 1 0"),
    ("apache-1.1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache org licenses license 2 0"),
    *((f"{name}-{v}", f"gnu org (?:licenses|copyleft)(?: old licenses)? {name} {v.removesuffix('.0').replace('.', ' ')}(?: 0)?") for name, versions in {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("3.0",)}.items() for v in versions),
    ("gpl", "gnu org (?:licenses|copyleft) gpl"),
    ("lgpl", "gnu org (?:licenses|copyleft) (?:lgpl|lesser)"),
    ("agpl", "gnu org licenses agpl"),
    ("gfdl", "gnu org (?:licenses|copyleft) fdl"),
    ("mpl-1.0", "mozilla org (?:en us )?mpl (?:mpl )?1 0"),
    ("mpl-1.1", "mozilla org (?:en us )?mpl (?:mpl )?1 1"),
    ("mpl-2.0", "mozilla org (?:en us )?mpl 2 0"),
    ("epl-1.0", "eclipse org legal epl (?:v ?)?1 ?0"),
    ("epl-2.0", "eclipse org legal epl (?:v ?)?2 ?0"),
    ("boost-1.0", "boost org license 1 0"),
    ("ofl-1.1", "sil org ofl"),
    ("unlicense", "unlicense org"),
    ("odbl-1.0", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "opendatacommons org licenses by(?: 1 0)?"),
    ("pddl", "opendatacommons org licenses pddl(?: 1 0)?"),
    ("postgresql", "postgresql org about licen[cs]e"),
    ("zlib", "gzip org zlib zlib license"),
)

_WORDS = r"(?:[^ ]+ ){1,16}?"
_COPY = r"permission to use copy modify and(?: or)? distribute this software"
_FSF = r" as published by the free software foundation(?: either)? version "
#: Key sentences of the licenses themselves: label, keyword and pattern.
SENTENCES = (
    ("mit", "is hereby granted free of charge", r"permission is hereby granted free of charge(?: to any person obtaining a copy of this software(?: and associated documentation files)?)?"),
    ("boost-1.0", "any person or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms(?: with or without modification are permitted)?"),
    ("bsd-3-clause", "neither the name", rf"neither the names? of {_WORDS}(?:nor the names of (?:its|their|any|the) )?{_WORDS}may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display"),
    ("isc", "with or without fee is hereby granted", rf"{_COPY} for any purpose with or without fee is hereby granted(?: provided that the above copyright notice)?"),
    ("0bsd", "with or without fee is hereby granted", rf"{_COPY} for any purpose with or without fee is hereby granted the software is provided as is"),
    ("postgresql", "without a written agreement is hereby granted", rf"{_COPY} and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "without fee is hereby granted", rf"{_COPY} and its documentation for any purpose(?: and| is hereby granted)? without fee(?: is hereby granted)?"),
    ("zlib", "the origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software(?: released into the public domain)?"),
    ("cc0-1.0", "associated a work with this deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("wtfpl", "do what the fuck you want to", r"(?:you just )?do what the fuck you want to(?: public license)?"),
    *((f"{label}-{v}", f"{name}general public license as published", rf"(?:gnu )?{name}general public licen[cs]e{_FSF}{v.replace('.0', '(?: 0)?').replace('.', ' ')}")
      for label, name, versions in (("gpl", "", ("1.0", "2.0", "3.0")), ("lgpl", "lesser ", ("2.1", "3.0")), ("lgpl", "library ", ("2.0",)), ("agpl", "affero ", ("3.0",))) for v in versions),
)

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_VERBS = "(?:licensed|released|distributed|available|published|covered|provided|shared|licenced|offered)"
#: What a text must have to be scanned at all: a group of these strings, or a match, in lower case.
GATE_STRINGS = (("licens",), ("licenc",), ("gpl",), ("gfdl",), ("cddl",), ("eupl",), ("wtfpl",), ("spdx",), ("cc0",), ("bsd",), ("perl",), ("commons",), ("hereby", "granted"), ("redistribution", "binary"), ("neither", "endorse"), ("advertising", "mentioning"), ("misrepresented",), ("unencumbered",), ("deed", "dedicated"), (".sil.org",), ("boost.org",), ("mozilla.org",), ("eclipse.org",), ("fuck", "want"), ("permission", "distribute", "fee"))
GATE = "|".join([*(x.replace(" ", _GAP) for x in ("cc by", "public domain", "rights reserved", "proprietary and", "no attribution")), r"(?<![0-9a-z])(?:mpl|epl|ofl) ?".replace(" ", f"(?:{_GAP})") + "(?:v|version)?(?:" + _GAP + ")?[0-9]", f"{_VERBS}{_GAP}under{_GAP}(?:(?:an?|the|terms|conditions|of|and){_GAP}){{0,6}}(?:mit|expat|isc|zlib|apache|asl|bsl|boost|mpl|epl|ofl|sil)(?![a-uw-z])"])

#: What every rule for identifiers needs; without it in a text none of them is tried.
_TAG = "spdx license identifier "
#: What every rule for addresses needs.
_LINK = " org "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK = "\x01"


def _spdx_rules():
    """Identifiers behind their tag, and behind AND or OR in an expression that follows it."""
    names = {i: re.sub(r"[-.]", " ", i.lower()) for i in SPDX}
    known = sorted({w for n in names.values() for w in n.split()} | {"only", "later", "or", "and", "with", "exception", "classpath", "llvm", "gcc", "linux", "syscall", "note", "bison", "font", "autoconf", "openssl", "universal", "fsf"}, key=lambda w: (-len(w), w))
    # repeated one by one, as Java's lookbehind takes no counted groups
    word = f"(?:(?:{'|'.join(known)}) )"
    before = f"{_TAG}{word}{f'{word}?' * 15}"
    for i, name in names.items():
        label = re.sub(r"^(cc-by[a-z-]*|gfdl)-[0-9.]+$", r"\1", i.lower())
        label = _RENAMED.get(label, label)
        full = name + ("(?: only| or later)?" if "gpl" in name or "gfdl" in name else "")
        yield f"spdx license identifier {name} ", f"spdx license identifier {full}", label, 40, 1.0
        yield f" org licenses {name} ", f"(?:opensource|spdx) org licenses {full}(?: html| txt)?", label, 38, 0.95
        for joint in ("or", "and"):
            yield f" {joint} {name} ", f"(?<={joint} ){full}(?<={before}{joint} {full})", label, 40, 1.0


def signatures() -> list[tuple[str, str, str, int, float]]:
    """All rules: keyword, pattern, label, priority and score, strongest first."""
    rules = [(keyword, mention.format(f"(?:{name})"), label.removesuffix("-short"), priority, score) for _, mention, priority, score in MENTIONS for label, (keyword, name) in FAMILIES.items()]
    under = rf"{_VERBS} under (?:an? |the )?(?:terms (?:and conditions )?of )?(?:an? |the )?"
    short = [(keyword, rf"(?:{under}|licen[cs]e (?:is )?)?(?:{name})(?: licen[cs]ed?)?", label, 20, 0.8) for label, keyword, name in SHORT]
    beside = [(keyword, rf"(?:{under}(?:{name})(?: licen[cs]e)?|(?:{name}) licen[cs]ed?|licen[cs]e (?:is )?(?:{name}))", label, 20, 0.8) for label, keyword, name in BESIDE]
    sentences = [(keyword, pattern, label, 35, 0.95) for label, keyword, pattern in SENTENCES]
    links = [(" org ", pattern, label, 38, 0.95) for label, pattern in LINKS]
    return [*_spdx_rules(), *links, *rules, *sentences, *short, *beside, *((phrase, phrase, label, 10, 0.6) for phrase, label in BASE.items())]


def scanned(documents: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), rules: Sequence[tuple[str, str, str, int, float]] | None = None) -> DataFrame:
    """For each document ``carried`` (a struct of the ``carry`` columns), ``n_words``, ``places`` (words at which a
    base phrase starts), ``base_labels``, ``labels``, ``hits`` (the detections left: start and end word, label,
    priority, score) and ``score``."""
    rows = documents.select(F.struct(*[F.col(c) for c in carry]).alias("carried"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lower = F.lower("text")
    gate = reduce(Column.__or__, [reduce(Column.__and__, [F.contains(lower, F.lit(x)) for x in group]) for group in GATE_STRINGS] + [F.rlike(lower, F.lit(GATE))])
    words = F.trim(F.regexp_replace(F.translate("text", _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    rows = rows.select("carried", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), F.when(gate, F.concat(F.lit(" "), words, F.lit(" "))).alias("words"))

    def places(pattern):
        """Spans of the pattern's matches, as words from 0."""
        whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
        marked = F.split(F.regexp_replace(F.col("words"), whole, F.lit(_MARK + "$0")), " ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i - 1)), lambda i: i.isNotNull())
        return F.zip_with(starts, F.regexp_extract_all(F.col("words"), whole, F.lit(0)), lambda i, m: F.struct(i.alias("start"), (i + F.size(F.split(m, " "))).alias("end")))

    def due(some):
        fields = ("keyword", "pattern", "label", "priority", "score")
        table = F.from_json(F.lit(json.dumps([dict(zip(fields, r)) for r in some])), "array<struct<keyword:string,pattern:string,label:string,priority:int,score:double>>")
        return F.filter(table, lambda r: F.contains(F.col("words"), r["keyword"]))

    told = signatures() if rules is None else list(rules)
    tagged = [r for r in told if r[1].startswith(_TAG) or f"(?<={_TAG}" in r[1]]
    links = [r for r in told if r[0].startswith(_LINK)]
    plain = [r for r in told if r not in tagged and r not in links]
    behind = lambda mark, some: [F.when(F.contains(F.col("words"), F.lit(mark)), due(some)).otherwise(F.slice(due(some[:1]), 1, 0))] if some else []
    tables = [*([due(plain)] if plain else []), *behind(_TAG, tagged), *behind(_LINK, links)]
    detect = lambda r: F.transform(places(r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["label"].alias("label"), r["score"].alias("score")))
    # sorted by start, longest and strongest first: a hit lies within an earlier one if that ends as late
    none = "array<struct<start:int,minus_end:int,minus_priority:int,label:string,score:double>>"
    rows = rows.withColumn("found", F.array_sort(F.flatten(F.transform(F.concat(*tables), detect))))
    step = lambda s, h: F.when(-h["minus_end"] > s["end"], F.struct((-h["minus_end"]).alias("end"), F.concat(s["kept"], F.array(h)).alias("kept"))).otherwise(s)
    rows = rows.withColumn("found", F.aggregate("found", F.struct(F.lit(-1).alias("end"), F.array().cast(none).alias("kept")), step)["kept"])
    # starts and ends of what is left both grow, so that detections overlap only where neighbours do
    h = F.col("found")
    meets = F.exists(F.arrays_zip(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))).alias("a"), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))).alias("b")), lambda p: p["b"]["start"] < -p["a"]["minus_end"])
    # strongest first: a detection stays unless it overlaps a stronger one that has stayed
    by_strength = F.transform(F.array_sort(F.transform(h, lambda x: F.struct(x["minus_priority"].alias("first"), x.alias("hit")))), lambda x: x["hit"])
    beaten = lambda kept, x: F.exists(kept, lambda y: (y["minus_priority"] < x["minus_priority"]) & (y["start"] < -x["minus_end"]) & (x["start"] < -y["minus_end"]))
    left = F.aggregate(by_strength, F.array().cast(none), lambda kept, x: F.when(beaten(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    rows = rows.withColumn("found", F.when(meets, F.array_sort(left)).otherwise(h))
    base = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(x).alias("label")) for p, x in BASE.items()])
    rows = rows.withColumn("base", F.flatten(F.transform(F.filter(base, lambda b: F.contains(F.col("words"), b["phrase"])), lambda b: F.transform(places(b["phrase"]), lambda p: F.struct(p["start"].alias("start"), b["label"].alias("label"))))))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    base_labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    hits = F.transform("found", lambda h: F.struct(h["start"].alias("start"), (-h["minus_end"]).alias("end"), h["label"].alias("label"), (-h["minus_priority"]).alias("priority"), h["score"].alias("score")))
    return rows.select(
        "carried",
        "n_words",
        empty(F.transform("base", lambda b: b["start"]), "array<int>").alias("places"),
        empty(F.array_sort(base_labels), "array<string>").alias("base_labels"),
        empty(F.array_sort(F.array_union(base_labels, F.transform("found", lambda h: h["label"]))), "array<string>").alias("labels"),
        hits.alias("hits"),
        F.coalesce(F.array_max(F.transform("found", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )
