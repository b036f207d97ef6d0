"""License scan by ordered signature rules, in DataFrame functions only.

Every rule has a keyword, a regular expression, a label, a priority and a confidence. A document's keywords are found
first by plain substring tests; only rules whose keyword it holds are run. A keyword has no blanks and stands in every
match of its regular expression, so this leaves no match out. All their matches become intervals; in order
of priority an interval is dropped where one kept before it contains it. Containment is transitive, so an interval goes
where any earlier one contains it: one scan by start with the furthest end of each priority finds these. No row meets
another one: there is no shuffle.

Odd input: a null text is empty (no words, no labels, score 0); rows are independent, so repeated rows repeat; of equal
intervals the first label by name stays; a very long text takes time in proportion to its length and its matches and is
scanned in one task; an empty table gives an empty result; columns other than ``keep`` and the text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: License identifiers with a keyword (in every match, no blanks) and the ways their names are written (white space is any gap).
FAMILIES = {
    "mit": ("mit", r"(?:the )?mit(?: \(expat\))?(?= licen[sc]e)"),
    "mit-expat": ("expat", r"expat"),
    "mit-0": ("mit-0", r"mit-0"),
    "mit-0-name": ("attribution", r"mit no attribution"),
    "apache-1.1": ("apache", r"apache(?: software)?(?: licen[sc]e)?,?(?: version| v)? ?1\.1"),
    "apache-2.0": ("apache", r"apache(?: software)?(?: licen[sc]e)?,?(?: version| v)?[ -]?2(?:\.0)?"),
    "apache": ("apache", r"apache(?: software)?(?= licen[sc]e)"),
    "bsd-0-clause": ("bsd", r"0bsd|(?:zero|0)[ -]clause bsd|bsd[ -]0[ -]clause"),
    "bsd-2-clause": ("bsd", r"(?:simplified|freebsd|(?:2|two)[ -]clause) bsd|bsd[ -](?:2|two)[ -]clause"),
    "bsd-3-clause": ("bsd", r"(?:new|modified|revised|(?:3|three)[ -]clause) bsd|bsd[ -](?:3|three)[ -]clause"),
    "bsd-4-clause": ("bsd", r"(?:original|old|(?:4|four)[ -]clause) bsd|bsd[ -](?:4|four)[ -]clause"),
    "bsd": ("bsd", r"bsd(?:-style)?(?= licen[sc]e)"),
    "gpl-1.0": ("gpl", r"gpl[ -]?v?1(?:\.0)?"),
    "gpl-2.0": ("gpl", r"gpl,?(?: version)?[ -]?v?2(?:\.0)?"),
    "gpl-3.0": ("gpl", r"gpl,?(?: version)?[ -]?v?3(?:\.0)?"),
    "lgpl-2.0": ("lgpl", r"lgpl,?(?: version)?[ -]?v?2(?:\.0)?(?!\.1)"),
    "lgpl-2.1": ("lgpl", r"lgpl,?(?: version)?[ -]?v?2\.1"),
    "lgpl-3.0": ("lgpl", r"lgpl,?(?: version)?[ -]?v?3(?:\.0)?"),
    "lgpl": ("lgpl", r"lgpl"),
    "lgpl-name": ("gnu", r"gnu (?:lesser|library) general public"),
    "agpl-1.0": ("agpl", r"agpl,?(?: version)?[ -]?v?1(?:\.0)?"),
    "agpl-3.0": ("agpl", r"agpl,?(?: version)?[ -]?v?3(?:\.0)?"),
    "agpl": ("agpl", r"agpl"),
    "agpl-name": ("affero", r"(?:gnu )?affero general public"),
    "gpl-1.0-name": ("gnu", r"gnu general public licen[sc]e,?(?: version| v)? ?1(?:\.0)?"),
    "gpl-2.0-name": ("gnu", r"gnu general public licen[sc]e,?(?: version| v)? ?2(?:\.0)?"),
    "gpl-3.0-name": ("gnu", r"gnu general public licen[sc]e,?(?: version| v)? ?3(?:\.0)?"),
    "gpl-any": ("gpl", r"(?:gnu )?gpl"),
    "gfdl": ("gfdl", r"gfdl"),
    "gfdl-name": ("documentation", r"gnu free documentation(?= licen[sc]e)"),
    "mpl-1.1": ("mozilla", r"mozilla public licen[sc]e,?(?: version| v)? ?1\.1"),
    "mpl-2.0": ("mozilla", r"mozilla public licen[sc]e,?(?: version| v)? ?2(?:\.0)?"),
    "mpl": ("mozilla", r"mozilla public"),
    "mpl-short": ("mpl", r"mpl[ -]?v?(?:1\.1|2\.0)"),
    "epl-1.0": ("eclipse", r"eclipse public licen[sc]e,?(?: version)?[ -]?v? ?1\.0"),
    "epl-2.0": ("eclipse", r"eclipse public licen[sc]e,?(?: version)?[ -]?v? ?2\.0"),
    "epl": ("eclipse", r"eclipse public"),
    "edl": ("eclipse", r"eclipse distribution"),
    "cddl-1.0": ("cddl", r"cddl[ -]?v?1\.0"),
    "cddl-1.1": ("cddl", r"cddl[ -]?v?1\.1"),
    "cddl": ("distribution", r"common development and distribution"),
    "isc": ("isc", r"isc(?= licen[sc]e)"),
    "zlib": ("zlib", r"zlib(?:/libpng)?(?= licen[sc]e)"),
    "unlicense": ("unlicense", r"unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl"),
    "artistic-1.0": ("artistic", r"artistic licen[sc]e,?(?: version)? ?1\.0"),
    "artistic-2.0": ("artistic", r"artistic licen[sc]e,?(?: version)? ?2\.0"),
    "artistic": ("artistic", r"artistic(?= licen[sc]e)"),
    "bsl-1.0": ("boost", r"boost software"),
    "busl-1.1": ("business", r"business source"),
    "sspl-1.0": ("server", r"server side public"),
    "elastic-2.0": ("elastic", r"elastic licen[sc]e(?: v?2(?:\.0)?)?"),
    "eupl-1.1": ("european", r"european union public licen[sc]e,?(?: version| v)?\.? ?1\.1"),
    "eupl-1.2": ("european", r"european union public licen[sc]e,?(?: version| v)?\.? ?1\.2"),
    "eupl": ("eupl", r"eupl"),
    "osl-3.0": ("software", r"open software licen[sc]e,?(?: version| v)?\.? ?3\.0"),
    "afl-3.0": ("academic", r"academic free licen[sc]e"),
    "ofl-1.1": ("font", r"(?:sil )?open font"),
    "ms-pl": ("microsoft", r"microsoft public"),
    "ms-rl": ("microsoft", r"microsoft reciprocal"),
    "cpl-1.0": ("common", r"common public(?= licen[sc]e)"),
    "ipl-1.0": ("ibm", r"ibm public"),
    "php": ("php", r"php(?= licen[sc]e)"),
    "python": ("python", r"python software foundation|python(?= licen[sc]e)"),
    "ruby": ("ruby", r"ruby(?= licen[sc]e)"),
    "openssl": ("openssl", r"openssl(?= licen[sc]e)"),
    "postgresql": ("postgresql", r"postgresql(?= licen[sc]e)"),
    "ncsa": ("ncsa", r"(?:university of illinois/)?ncsa open source"),
    "vim": ("vim", r"vim(?= licen[sc]e)"),
    "w3c": ("w3c", r"w3c software"),
    "x11": ("x11", r"x11(?= licen[sc]e)"),
    "cecill": ("cecill", r"cecill(?:-[abc])?"),
    "mulan": ("mulan", r"mulan (?:psl|permissive software)"),
    "odbl": ("database", r"open (?:data commons )?(?:open )?database"),
    "pddl": ("dedication", r"public domain dedication"),
    "json": ("json", r"json(?= licen[sc]e)"),
    "beerware": ("beer", r"beer-?ware"),
    "ogl": ("government", r"open government"),
    "openrail": ("rail", r"(?:bigscience |creativeml )?open ?rail(?:-m)?"),
    "llama": ("llama", r"llama(?: \d(?:\.\d)?)? community"),
    "proprietary": ("proprietary", r"proprietary(?: and confidential)?"),
}
CC_PARTS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative|ative works|atives|s)?", "nc": "non-?commercial"}
#: Whole sentences that say what holds without a license's name.
NOTICES = {
    "mit": ("granted", r"permission is hereby granted, free of charge, to any person obtaining"),
    "isc": ("distribute", r"permission to use, copy, modify,? and(?:/or)? distribute this software"),
    "bsd": ("redistribution", r"redistribution and use in source and binary forms"),
    "zlib": ("as-is", r"this software is provided ['‘\"]as-is['’\"], without any express"),
    "apache-2.0": ("apache.org/licenses", r"https?://(?:www\.)?apache\.org/licenses/license-2\.0"),
    "gpl-any": ("gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses"),
    "mpl-2.0": ("mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0"),
    "unlicense": ("unencumbered", r"free and unencumbered software released into the public domain"),
    "cc0-1.0": ("cc0", r"cc0(?: 1\.0)?(?: universal)?"),
    "cc0-1.0-url": ("creativecommons.org", r"creativecommons\.org/publicdomain/zero"),
    "public-domain": ("domain", r"(?:in|into|to) the public domain"),
    "copyright": ("copyright", r"copyright (?:\(c\)|©)?[ ,]?(?:19|20)\d\d"),
    "copyright-sign": ("©", r"© ?(?:19|20)\d\d"),
    "copyright-c": ("(c)", r"\(c\) (?:19|20)\d\d"),
    "no-warranty": ("warrant", r"without (?:any )?warrant(?:y|ies) of any kind"),
    "no-redistribution": ("redistributed", r"(?:may|must) not be redistributed"),
    "no-copies": ("copied", r"(?:may|must) not be copied"),
    "no-reproduction": ("reproduced", r"(?:may|must) not be reproduced"),
    "confidential": ("confidential", r"(?:strictly |company )confidential"),
    "non-commercial": ("commercial", r"(?:for )?non-?commercial use only"),
    "patent": ("patent", r"patent pending"),
    "trademark": ("trademark", r"(?:is a|are) (?:registered )?trademarks? of"),
    "eula": ("agreement", r"end[ -]user licen[sc]e agreement"),
}
#: Labels that several rules share.
SAME = {"mit-expat": "mit", "mit-0-name": "mit-0", "gfdl-name": "gfdl", "cc0-1.0-url": "cc0-1.0", "no-copies": "no-redistribution", "no-reproduction": "no-redistribution", "gpl-1.0-name": "gpl-1.0", "gpl-2.0-name": "gpl-2.0", "gpl-3.0-name": "gpl-3.0", "lgpl-name": "lgpl", "agpl-name": "agpl", "gpl-any": "gpl", "mpl-short": "mpl", "copyright-sign": "copyright", "copyright-c": "copyright"}

#: Fixed values of the base scan.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
GAP = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.6
#: In every text that speaks of a license or licence.
LICENSE = "licen"


def _speaks_of_license(regex: str) -> bool:
    """Whether every match (with what is looked ahead to) holds LICENSE: it does outside of optional groups and choices."""
    needed = re.sub(r"\(\?:[^()]*\)\?", "", regex)
    return "licen[sc]e" in needed and "|" not in re.sub(r"\([^()]*\)", "", needed)


def _rule(keywords: list[str], regex: str, label: str, priority: int, confidence: float) -> tuple[list[str], str, str, int, float]:
    body = re.sub(r"\[[^\]]*\]| ", lambda m: r"\s+" if m[0] == " " else m[0].replace(" ", r"\s"), regex).replace(r"\s+?", r"\s*")
    return keywords, rf"(?i)(?<!{WORD})(?:{body})(?!{WORD})", SAME.get(label, label), priority, confidence


def rules() -> list[tuple[list[str], str, str, int, float]]:
    """(keywords, regex, label, priority, confidence); a smaller priority goes first.

    A rule is run where all its keywords are in the text; every match of its regex holds them.
    """
    out = []
    names = dict(FAMILIES)
    for part in CC_PARTS:
        words = "[- ]".join(CC_NAMES[p] for p in part.split("-"))
        names[f"cc-{part}"] = ("cc", rf"cc[ -]{part.replace('-', '[ -]')}(?:[ -]\d\.\d)?(?![ -](?:sa|nd|nc))")
        names[f"cc-{part}-name"] = ("commons", rf"creative commons {words}(?! ?-? ?(?:share|no|non))")
        names[f"cc-{part}-url"] = ("creativecommons.org", rf"creativecommons\.org/licenses/{part}/\d\.\d")
    for name, (keyword, regex) in names.items():
        label = name.removesuffix("-name").removesuffix("-url") if name.startswith("cc-") else SAME.get(name, name)
        own = [keyword, LICENSE] if _speaks_of_license(regex) else [keyword]
        out.append(_rule(["spdx"], rf"spdx-license-identifier: ?{label.replace('.', r'[.]')}(?:-only|-or-later)?", label, 1, 0.99))
        out.append(_rule(own, rf"(?:licen[sc]ed|released|distributed|available|published|provided|covered) (?:under|by)(?: the)?(?: terms of(?: the)?)? (?:{regex})(?: (?:public )?licen[sc]e)?", label, 2, 0.95))
        out.append(_rule(own, rf"(?:{regex})(?: (?:public )?licen[sc]e)?", label, 4, 0.7))
    out += [_rule([keyword], regex, label, 3, 0.9) for label, (keyword, regex) in NOTICES.items()]
    return out


SPAN = "struct<priority:int,start:int,back:int,label:string,confidence:double>"
RULE = "array<struct<keywords:array<string>,regex:string,label:string,priority:int,confidence:double>>"
#: Items that a scan takes at once: an array that grows by one item is copied, so long ones are put together from these.
STRETCH = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _scanned(items: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The spans that ``step`` (carry, item) -> (carry, array of spans) gives for all items in order."""
    none = lambda kind: F.array().cast(kind)

    def stretch(state: Column, part: Column) -> Column:
        def one(s: Column, x: Column) -> Column:
            after, found = step(s["carry"], x)
            return F.struct(after.alias("carry"), F.concat(s["out"], found).alias("out"))

        done = F.aggregate(part, F.struct(state["carry"].alias("carry"), none(f"array<{SPAN}>").alias("out")), one)
        return _let(done, lambda d: F.struct(d["carry"].alias("carry"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    def run(all_items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / STRETCH).cast("int")), lambda i: F.slice(all_items, i * STRETCH + 1, STRETCH))
        start = F.struct(carry.alias("carry"), none(f"array<array<{SPAN}>>").alias("out"))
        return F.when(F.size(all_items) > 0, F.flatten(F.aggregate(parts, start, stretch, lambda s: s["out"]))).otherwise(none(f"array<{SPAN}>"))

    return _let(items, run)


def _spans(text: Column, rule: Column) -> Column:
    """Intervals of all matches of a rule: the lengths of what stands between matches and of the matches add up."""
    between, hits = F.split(text, rule["regex"], -1), F.regexp_extract_all(text, rule["regex"], F.lit(0))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        a = at + F.coalesce(F.length(pair["0"]), F.lit(0))
        b = a + F.length(pair["1"])
        return b, F.array(F.struct(rule["priority"].alias("priority"), a.alias("start"), (-b).alias("back"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

    return _scanned(F.filter(F.arrays_zip(between.alias("0"), hits.alias("1")), lambda p: p["1"].isNotNull()), F.lit(0), step)


def _uncontained(spans: Column) -> Column:
    """Intervals that none before them (by priority, start and end) contains, in that order."""
    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["back"].alias("back"), x["priority"].alias("priority"), x.alias("x"))))
    levels = sorted({r[3] for r in rules()})

    def step(reach: Column, item: Column) -> tuple[Column, Column]:
        end, level = -item["back"], item["priority"]
        before = F.greatest(*(F.when(F.lit(k) <= level, reach[f"r{k}"]).otherwise(-1) for k in levels))
        after = F.struct(*(F.when(level == k, F.greatest(reach[f"r{k}"], end)).otherwise(reach[f"r{k}"]).alias(f"r{k}") for k in levels))
        return after, F.when(before < end, F.array(item["x"])).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.sort_array(_scanned(by_start, F.struct(*(F.lit(-1).alias(f"r{k}") for k in levels)), step))


def detections(text: Column) -> Column:
    """Kept intervals (priority, start, back = -end, label, confidence) of a text, in order of priority and start."""
    table = rules()
    keywords = sorted({k for r in table for k in r[0]} - {LICENSE})
    alone = sorted({k for r in table for k in r[0] if LICENSE not in r[0]})
    words = lambda ks: F.from_json(F.lit(json.dumps(ks)), "array<string>")
    literal = F.from_json(F.lit(json.dumps([dict(zip(("keywords", "regex", "label", "priority", "confidence"), r)) for r in table])), RULE)  # Spark folds it to one literal

    def present(low: Column) -> Column:
        licensed = F.contains(low, F.lit(LICENSE))
        own = F.filter(F.when(licensed, words(keywords)).otherwise(words(alone)), lambda k: F.contains(low, k))
        return F.when(licensed, F.array_append(own, F.lit(LICENSE))).otherwise(own)

    live = _let(_let(F.lower(text), present), lambda found: F.when(F.size(found) > 0, F.filter(literal, lambda r: F.size(F.array_except(r["keywords"], found)) == 0)))
    none = F.array().cast(f"array<{SPAN}>")
    return F.coalesce(_let(F.flatten(F.transform(live, lambda r: _spans(text, r))), lambda spans: F.when(F.size(spans) > 0, _uncontained(spans))), none)


def scan(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, the base scan, detections (kept intervals), labels and score of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = df.select(*keep, text.alias("_text"))
    low = F.lower("_text")
    gate = F.contains(low, F.lit("license")) | F.contains(low, F.lit("reserved")) | (F.contains(low, F.lit("cc")) & F.contains(low, F.lit("by")))
    t = F.col("_text")
    words = lambda c: F.regexp_count(c, F.lit(f"{WORD}+"))
    phrase = "|".join(p.replace(" ", GAP) for p in PHRASES)
    regex = F.lit(rf"(?i)(?<!{WORD})(?:{phrase})(?!{WORD})")
    out = own.withColumn("n_words", words(t).cast("long"))
    out = out.withColumn("_hits", F.when(gate, F.regexp_extract_all(t, regex, F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("n_base", F.size("_hits").cast("long"))
    found = F.col("n_base") > 0
    pieces = F.split(t, regex, -1)
    out = out.withColumn("first_word", F.when(found, words(F.element_at(pieces, 1)).cast("long")))
    out = out.withColumn("last_word", F.when(found, F.col("n_words") - words(F.element_at(pieces, -1)) - words(F.element_at("_hits", -1))).cast("long"))
    named = F.transform("_hits", lambda h: F.when(F.lower(h).startswith("cc"), PHRASES["cc by"]).when(F.lower(h).startswith("g"), PHRASES["general public license"]).otherwise(PHRASES["all rights reserved"]))
    out = out.withColumn("_base", F.array_sort(F.array_distinct(named)))
    out = out.withColumn("detections", detections(t))
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    out = out.withColumns({"base_labels": F.concat_ws(",", "_base"), "labels": F.concat_ws(",", labels), "score": F.greatest(best, F.when(found, BASE_CONFIDENCE).otherwise(0.0))})
    return out.drop("_text", "_hits", "_base")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", "text")).drop("detections")
