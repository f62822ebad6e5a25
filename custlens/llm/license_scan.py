"""License scans by ordered signature rules.

Every rule is a regular expression over the normal form of a text: its words in lower case (A-Z only), one blank between
them. Rules are grouped by a keyword, and only groups whose keyword occurs are tried. A detection that lies inside
another one of a rule of higher rank is suppressed, so that a full notice keeps its own label and not those of the
shorter names in it.

There are four kinds of rules: identifiers behind an SPDX tag, the wording of standard notices, names in several forms, and
bare names such as "MIT" that count only where a text says that it is licensed under them.

Words are runs of characters other than ASCII control characters, blanks and punctuation. The work is done by built-in
expressions inside each row; nothing is shuffled.

Defined results: a missing or empty text has no words, no labels, score 0 and null places; rows are judged one by one,
so repeated rows and repeated or missing ids each get their own result; an empty table gives an empty result; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import let, plain_words, rows_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose places count as base detections, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: A text without any of these holds no signature; every name or template below has one of them.
GATE = (
    "(?i)licen[cs]e|spdx|gpl|cc0|public[^a-z0-9]+domain|creative[^a-z0-9]+commons|clause[^a-z0-9]+bsd"
    "|no[^a-z0-9]+attribution|all[^a-z0-9]+rights[^a-z0-9]+reserved|cc[^a-z0-9]+by|is[^a-z0-9]+hereby[^a-z0-9]+granted"
    "|redistribution[^a-z0-9]+and[^a-z0-9]+use|provided[^a-z0-9]+as[^a-z0-9]+is"
    "|(?<![a-z0-9])(?:mit|bsd|apache|isc|mpl|epl|cddl|eupl)(?![a-uw-z])"
)

CC_KINDS = ("-nc-nd", "-nc-sa", "-nc", "-nd", "-sa", "")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Label, keyword and name of the licenses, as they read in normal form. A name with a version comes before the same
#: name without.
NAMES = (
    ("gpl-1.0", "general public", "(?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? 1(?: 0)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? 2(?: 0)?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? 3(?: 0)?"),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e"),
    ("gpl-2.0", "gpl", "gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", "gpl ?v?3(?: 0)?"),
    ("lgpl-2.0", "general public", "(?:gnu )?library general public licen[cs]e(?: lgpl)?(?: version| v)? 2(?: 0)?"),
    ("lgpl-2.1", "general public", "(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v)? 2 1"),
    ("lgpl-3.0", "general public", "(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v)? 3(?: 0)?"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[cs]e(?: agpl)?(?: version| v)? 3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("gfdl-1.2", "free documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 2"),
    ("gfdl-1.3", "free documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 3"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e"),
    ("apache-1.0", "apache", "apache(?: software)? licen[cs]e(?: version| v)? 1 0"),
    ("apache-1.1", "apache", "apache(?: software)? licen[cs]e(?: version| v)? 1 1"),
    ("apache-2.0", "apache", "apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("apache", "apache", "apache(?: software)? licen[cs]e"),
    ("mit-0", "mit", "mit no attribution(?: licen[cs]e)?"),
    ("mit", "mit", "mit(?: x11)? licen[cs]e"),
    ("x11", "x11", "x11 licen[cs]e"),
    ("bsd-2-clause", "bsd", "(?:2|two) clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:3|three) clause bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:4|four) clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd) bsd licen[cs]e"),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified) bsd licen[cs]e"),
    ("0bsd", "bsd", "zero clause bsd(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("mpl-1.0", "mozilla", "mozilla public licen[cs]e(?: mpl)?(?: version| v)? 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: mpl)?(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: mpl)?(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e(?: epl)?(?: version| v)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e(?: epl)?(?: version| v)? 2(?: 0)?"),
    ("epl", "eclipse", "eclipse public licen[cs]e"),
    ("cpl-1.0", "common public", "common public licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("cddl-1.0", "common development", "common development and distribution licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("cddl-1.1", "common development", "common development and distribution licen[cs]e(?: version| v)? 1 1"),
    ("cddl", "common development", "common development and distribution licen[cs]e"),
    ("eupl-1.1", "european union", "european union public licen[cs]e(?: version| v)? 1 1"),
    ("eupl-1.2", "european union", "european union public licen[cs]e(?: version| v)? 1 2"),
    ("eupl", "european union", "european union public licen[cs]e"),
    ("osl-3.0", "open software", "open software licen[cs]e(?: version| v)? 3(?: 0)?"),
    ("afl-3.0", "academic free", "academic free licen[cs]e(?: version| v)? 3(?: 0)?"),
    ("artistic-1.0", "artistic", "artistic licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("artistic", "artistic", "artistic licen[cs]e"),
    ("bsl-1.0", "boost", "boost software licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("bsl", "boost", "boost software licen[cs]e"),
    ("isc", "isc", "isc licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", "the unlicense"),
    ("wtfpl", "public", "do what the fuck you want to public licen[cs]e"),
    ("ofl-1.1", "open font", "(?:sil )?open font licen[cs]e(?: version| v)? 1 1"),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e"),
    ("odbl-1.0", "open database", "open (?:data commons open )?database licen[cs]e(?: version| v)? 1 0"),
    ("odbl", "open database", "open (?:data commons open )?database licen[cs]e"),
    ("psf-2.0", "python", "python software foundation licen[cs]e(?: version| v)? 2"),
    ("psf", "python", "python software foundation licen[cs]e"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike"),
    ("cc-by", "creative commons", "creative commons attribution"),
    ("public-domain", "public domain", "public domain"),
    ("proprietary", "rights reserved", "all rights reserved"),
    # short forms
    *((f"cc-by{kind}-{version}", "cc by", f"(?:creative commons )?cc by{kind.replace('-', ' ')}"
       f"(?: version| v)? v?{version.replace('.0', '(?: 0)?').replace('.', ' ')}(?: international| unported| generic)?")
      for kind in CC_KINDS for version in CC_VERSIONS),
    *((f"cc-by{kind}", "cc by", f"(?:creative commons )?cc by{kind.replace('-', ' ')}") for kind in CC_KINDS),
    ("gpl-1.0", "gpl", "(?:gnu )?gpl(?: version| v)? v?1(?: 0)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?:v2| ?(?:version |v )?v?2)(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?:v3| ?(?:version |v )?v?3)(?: 0)?"),
    ("lgpl-2.0", "lgpl", "(?:gnu )?lgpl(?:v2| ?(?:version |v )?v?2)(?: 0)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?:v2| ?(?:version |v )?v?2) 1"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl(?:v3| ?(?:version |v )?v?3)(?: 0)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl(?:v3| ?(?:version |v )?v?3)(?: 0)?"),
    ("apache-2.0", "apache", "(?:apache(?: version| v)? v?2(?: 0)? licen[cs]e|apache licen[cs]e v2(?: 0)?)"),
    ("bsd-2-clause", "bsd", "bsd (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "bsd (?:4|four) clause(?: licen[cs]e)?"),
    ("mpl-1.1", "mpl", "mpl(?: version| v)? v?1 1"),
    ("mpl-2.0", "mpl", "mpl(?:v2| ?(?:version |v )?v?2)(?: 0)?"),
    ("epl-1.0", "epl", "epl(?: version| v)? v?1(?: 0)?"),
    ("epl-2.0", "epl", "epl(?: version| v)? v?2(?: 0)?"),
    ("cddl-1.0", "cddl", "cddl(?: version| v)? v?1(?: 0)?"),
    ("cddl-1.1", "cddl", "cddl(?: version| v)? v?1 1"),
    ("eupl-1.1", "eupl", "eupl(?: version| v)? v?1 1"),
    ("eupl-1.2", "eupl", "eupl(?: version| v)? v?1 2"),
)

#: Names that mean something else too; they count in the form "licensed under" only.
BARE_NAMES = (
    ("apache-2.0", "apache", "apache(?: version| v)? v?2(?: 0)?"),
    ("mit", "mit", "mit"), ("apache", "apache", "apache"), ("bsd", "bsd", "bsd"), ("isc", "isc", "isc"),
    ("gpl", "gpl", "(?:gnu )?gpl"), ("lgpl", "gpl", "(?:gnu )?lgpl"), ("agpl", "gpl", "(?:gnu )?agpl"),
    ("mpl", "mpl", "mpl"), ("epl", "epl", "epl"),
)

_GNU = ("(?:gnu )?{} (?:gpl |lgpl |agpl )?as published by the free software foundation (?:either |using |at |in )*"
        "version {}(?: of the licen[cs]e)?")
_BSD = "redistribution and use in source and binary forms with or without modification are permitted"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software"
_GRANTED = "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"

#: Wording of the standard notices: label, keyword, pattern. The clauses that tell two of a family apart follow within
#: 1,000 characters, which is less than the length of one notice.
NOTICES = (
    *((f"{label}-{version}", "published by the free software", _GNU.format(name, version.replace(".0", "(?: 0)?").replace(".", " ")))
      for label, name, versions in (
          ("agpl", "affero general public licen[cs]e", ("3.0",)),
          ("lgpl", "(?:lesser|library) general public licen[cs]e", ("2.1", "2.0", "3.0")),
          ("gpl", "general public licen[cs]e", ("1.0", "2.0", "3.0")),
          ("gfdl", "free documentation licen[cs]e", ("1.2", "1.3")))
      for version in versions),
    *((f"gfdl-{version}", "free documentation", "under the terms of the (?:gnu )?free documentation licen[cs]e version "
       + version.replace(".", " ")) for version in ("1.2", "1.3")),
    ("mit-0", "permission is hereby granted", _MIT + "(?=.{0,1000}? furnished to do so (?!subject))"),
    ("mit", "permission is hereby granted", _MIT),
    ("bsl-1.0", "permission is hereby granted",
     "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying"),
    ("bsd-4-clause", "redistribution and use", _BSD + "(?=.{0,1000}? all advertising materials mentioning)"),
    ("bsd-3-clause", "redistribution and use", _BSD + "(?=.{0,1000}? (?:neither the names? of|the names? of .{0,200}? may not be used to endorse))"),
    ("bsd-2-clause", "redistribution and use", _BSD),
    ("isc", "is hereby granted", _GRANTED + " provided that the above copyright notice"),
    ("0bsd", "is hereby granted", _GRANTED + "(?! provided)"),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
)

#: SPDX identifiers; their lower case is the label.
SPDX = (
    "MIT", "MIT-0", "X11", "ISC", "Zlib", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-1.0", "Apache-1.1",
    "Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3",
    "MPL-1.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CPL-1.0", "CDDL-1.0", "CDDL-1.1", "EUPL-1.1", "EUPL-1.2", "OSL-3.0",
    "AFL-3.0", "Artistic-1.0", "Artistic-2.0", "BSL-1.0", "Unlicense", "WTFPL", "OFL-1.1", "ODbL-1.0", "PSF-2.0", "CC0-1.0",
    *(f"CC-BY{kind.upper()}-{version}" for kind in CC_KINDS for version in CC_VERSIONS),
)

#: How a text names its license, best evidence first: the pattern around the name and its weight.
FORMS = (
    ("spdx licen[cs]e identifier {name}", 1.0),
    ("(?:licen[cs]ed|released|distributed|published|covered|made available|available|provided|redistributed) under "
     "(?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[cs]e)?", 0.9),
    ("(?:subject to|governed by|according to|pursuant to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}"
     "(?: licen[cs]e)?", 0.8),
    ("(?:a copy of|see|read) (?:the )?{name}(?: licen[cs]e)?", 0.6),
    ("{name}", 0.5),
)


@dataclass(frozen=True)
class Rule:
    rank: int
    label: str
    keyword: str
    pattern: str
    weight: float


def _spdx_id(name: str) -> str:
    """An identifier in normal form, with what may follow its version."""
    words = name.lower().replace("-", " ").replace(".", " ")
    if words == "mit":
        return "mit(?! 0 )"
    if words.endswith(" 0") and "." in name:
        words = words[:-2] + "(?: 0|(?! [0-9] ))"
    return words + ("(?: only| or later)?" if name.startswith(("GPL", "LGPL", "AGPL", "GFDL")) else "")


def spdx_rules() -> list[Rule]:
    """One rule per identifier: a tag with an expression that holds it.

    All match the whole expression and share a rank, so that each license of an expression is kept.
    """
    ids = [_spdx_id(name) for name in SPDX]
    item = f"(?:{'|'.join(ids)})(?: with (?:linux syscall note|(?:[a-z0-9]+ ){{1,3}}exception(?: [0-9]+ [0-9]+)?))?"
    return [
        Rule(0, name.lower(), "spdx licen", f"(?<= )spdx licen[cs]e identifier (?=(?:{item} (?:and|or) )*{own}(?= ))"
             f"{item}(?: (?:and|or) {item})*(?= )", 1.0)
        for name, own in zip(SPDX, ids)
    ]


def signature_rules() -> list[Rule]:
    """Identifiers, notices, all names in all forms, bare names; a form comes before the next, a name before the next."""
    rules = spdx_rules()

    def add(label: str, keyword: str, pattern: str, weight: float) -> None:
        rules.append(Rule(len(rules), label, keyword, f"(?<= ){pattern}(?= )", weight))

    for label, keyword, pattern in NOTICES:
        add(label, keyword, pattern, 0.95)
    for form, weight in FORMS:
        for label, keyword, name in NAMES:
            add(label, keyword, form.replace("{name}", name), weight)
    form, weight = FORMS[1]
    for label, keyword, name in BARE_NAMES:
        add(label, keyword, form.replace("{name}", name), weight)
    return rules


def _groups(rules: list[Rule]) -> Column:
    """The rules as a constant: an array of keywords with their rules."""
    keywords = dict.fromkeys(r.keyword for r in rules)
    return F.array(*(
        F.struct(
            F.lit(keyword).alias("keyword"),
            F.array(*(
                F.struct(F.lit(r.rank).alias("rank"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"),
                         F.lit(r.weight).alias("weight"))
                for r in rules if r.keyword == keyword
            )).alias("rules"),
        )
        for keyword in keywords
    ))


def _spans(text: Column, rule: Column) -> Column:
    """All places of a rule's pattern in a text as (start, end, rank, label, weight)."""
    kind = "array<struct<start:int,end:int,rank:int,label:string,weight:double>>"
    found, between = F.regexp_extract_all(text, rule["pattern"], F.lit(0)), F.split(text, rule["pattern"], -1)

    def walk(matches: Column, gaps: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(gaps[i])
            return let(start, lambda s: F.struct(
                (s + F.length(matches[i])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    s.alias("start"), (s + F.length(matches[i])).alias("end"), rule["rank"].alias("rank"),
                    rule["label"].alias("label"), rule["weight"].alias("weight"),
                )).cast(kind)).alias("out"),
            ))

        return F.aggregate(
            F.sequence(F.lit(0), F.size(matches) - 1), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
            step, lambda acc: acc["out"],
        )

    return let(found, lambda matches: F.when(F.size(matches) == 0, F.array().cast(kind)).otherwise(
        let(between, lambda gaps: walk(matches, gaps))))


def detections(words: Column, rules: list[Rule]) -> Column:
    """What remains of the rules' detections in an array of lower-case words after suppression."""
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def matched(normal: Column) -> Column:
        groups = F.filter(_groups(rules), lambda g: F.contains(normal, g["keyword"]))
        return F.flatten(F.transform(F.flatten(F.transform(groups, lambda g: g["rules"])), lambda r: _spans(normal, r)))

    def inside(d: Column, e: Column) -> Column:
        return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & (e["rank"] < d["rank"])

    def wider(d: Column, e: Column) -> Column:
        return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & (e["end"] - e["start"] > d["end"] - d["start"])

    return let(let(text, matched), lambda found: F.filter(
        found, lambda d: ~F.exists(found, lambda e: inside(d, e) | wider(d, e))))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        test = words[i] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (words[i + k] == part)
        return test

    return F.when(F.size(words) < len(parts), F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: base places and labels, all labels, and the weight of the best detection.

    ``detections`` lists what remains after suppression: start and end in the normal form, rule rank, label, weight.
    """
    rules = signature_rules() if rules is None else rules
    strings, found_type = "array<string>", "array<struct<start:int,end:int,rank:int,label:string,weight:double>>"

    def result(n: Column, places: Column, base: Column, found: Column) -> Column:
        labels = F.concat(base, F.transform(found, lambda d: d["label"]))
        weights = F.concat(F.transform(base, lambda _: F.lit(0.5)), F.transform(found, lambda d: d["weight"]))
        return F.struct(
            n.cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
            F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
            _joined(base).alias("base_labels"), _joined(labels).alias("labels"),
            F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"), found.alias("detections"),
        )

    def scanned(words: Column) -> Column:
        at = F.array(*(_places(words, phrase) for phrase in BASE))
        names = list(BASE.values())
        return let(at, lambda each: result(
            F.size(words), F.flatten(each),
            F.concat(*(F.when(F.size(each[i]) > 0, F.array(F.lit(n))).otherwise(F.array().cast(strings))
                       for i, n in enumerate(names))),
            detections(words, rules),
        ))

    text = F.col("text")
    words = plain_words(text)
    none = F.array()
    lowered = lambda w: F.split(F.translate(F.array_join(w, " "), UPPER, LOWER), " ")
    outcome = let(words, lambda w: F.when(
        (F.size(w) > 0) & text.rlike(GATE), let(lowered(w), scanned)
    ).otherwise(result(F.size(w), none.cast("array<int>"), none.cast(strings), none.cast(found_type))))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.select("doc_id", rows_of(outcome))
