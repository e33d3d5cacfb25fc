"""Scalar value functions: Column in, Column out.

All of them are built-in expressions except the Unicode step of
``normalize_whitespace``, which Spark has no function for.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters a script engine's \s matches (the BOM is removed before).
WHITESPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ODD_SPACE = WHITESPACE.replace("\\r ", "\\r")
ZERO_WIDTH_MARKS = ("\u200b", "\u200c", "\u200d", "\ufeff")
ZERO_WIDTH = r"[\u200b-\u200d\ufeff]"
#: Anything outside this set may change under NFKC; everything inside is stable
#: (or, for the no-break space, is whitespace either way).
MAY_DECOMPOSE = (r"[^\x00-\x7f\u00a0-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff"
                 r"\u200b-\u200d\u2013\u2014\u2018\u2019\u201c\u201d\u2022\u20ac\u20b9\ufeff]")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: The same, but not to be moved or repeated by the optimiser: into a join condition, for instance, where no Python runs.
_nfkc_in_place = F.pandas_udf(lambda text: text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t)), StringType()).asNondeterministic()


def let(value: Column, body) -> Column:
    """``body`` of a value that it uses several times, so that the value is written and computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse_space(text: Column) -> Column:
    """Drop zero-width characters, collapse whitespace runs, trim. No Unicode step."""
    def without_marks(t: Column) -> Column:
        marked = F.contains(t, F.lit(ZERO_WIDTH_MARKS[0]))
        for mark in ZERO_WIDTH_MARKS[1:]:
            marked = marked | F.contains(t, F.lit(mark))
        return F.when(marked, F.regexp_replace(t, ZERO_WIDTH, "")).otherwise(t)

    # Single plain spaces, by far the most common, stay untouched.
    return F.trim(F.regexp_replace(let(text, without_marks), f"{WHITESPACE}{{2,}}|{ODD_SPACE}", " "))


def nfkc(text: Column, in_place: bool = False) -> Column:
    """Unicode NFKC form. Python sees only the texts it can change: the others travel as nulls."""
    return F.coalesce((_nfkc_in_place if in_place else _nfkc)(F.when(text.rlike(MAY_DECOMPOSE), text)), text)


def normalize_whitespace(text: Column) -> Column:
    """NFKC, then ``collapse_space``."""
    return collapse_space(nfkc(text))


def text_or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_number(text: Column, grouping: str = "guess") -> Column:
    """Number from free text, or null.

    The later of the last comma and the last dot is read as the decimal mark and the
    longest numeric prefix counts, so ``1,234`` is 1.234. ``grouping='us'`` reads
    commas as thousands marks instead.
    """
    def canonical(kept: Column) -> Column:
        point = F.replace(kept, F.lit(","), F.lit(""))
        if grouping == "us":
            return point
        comma = F.regexp_replace(F.replace(kept, F.lit("."), F.lit("")), r"^([^,]*),", "$1.")
        return F.when(kept.rlike(r",[^.]*$"), comma).otherwise(point)

    number = let(F.regexp_replace(text, r"[^\d,.-]", ""), canonical)
    # Up to 300 digits make a finite double; anything longer is no number.
    return F.regexp_extract(number, r"^([+-]?(?:\d{1,300}(?!\d)\.?\d*|\.\d+))", 1).try_cast("double")


# Accepted date spellings as (shape, format). Month names may be in any
# case; everything without a zone is read in the session zone (UTC).
DATE_SHAPES = (
    (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{3})?(Z|[+-]\d\d:\d\d)$", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{3})?$", "yyyy-MM-dd'T'HH:mm:ss[.SSS]"),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d(Z|[+-]\d\d:\d\d)?$", "yyyy-MM-dd'T'HH:mm[XXX]"),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{3})?$", "yyyy-MM-dd HH:mm:ss[.SSS]"),
    (r"^\d{4}-\d\d$", "yyyy-MM"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", "MMM d[,] yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4}$", "MMMM d[,] yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d [A-Za-z]+$", "d MMM yyyy HH:mm:ss z"),
    (r"^\d{4}$", "yyyy"),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d$", "yyyy-MM-dd HH:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4},? \d{1,2}:\d\d(:\d\d)?$", "M/d/yyyy[,] H:mm[:ss]"),
    (r"^\d{1,2}/\d{1,2}/\d{4},? \d{1,2}:\d\d(:\d\d)? [AP]M$", "M/d/yyyy[,] h:mm[:ss] a"),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4},? \d{1,2}:\d\d(:\d\d)?$", "MMM d[,] yyyy[,] H:mm[:ss]"),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4},? \d{1,2}:\d\d(:\d\d)? [AP]M$", "MMM d[,] yyyy[,] h:mm[:ss] a"),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4},? \d{1,2}:\d\d(:\d\d)?$", "MMMM d[,] yyyy[,] H:mm[:ss]"),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4},? \d{1,2}:\d\d(:\d\d)? [AP]M$", "MMMM d[,] yyyy[,] h:mm[:ss] a"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4} \d\d:\d\d:\d\d GMT[+-]\d{4}$", "MMM d yyyy HH:mm:ss 'GMT'xx"),
)


def _read_shape(text: Column) -> Column:
    """The one format whose shape fits is tried: failing parses are far dearer than a look at the shape."""
    dated = F.regexp_replace(text, r"^(?:[A-Za-z]{3}, |(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) )", "")
    spelled = let(F.regexp_extract(dated, r"^([^A-Za-z]*)([A-Za-z]{3,})(?= )", 2), lambda month: F.when(
        month == "", dated).otherwise(F.regexp_replace(dated, month, F.initcap(F.lower(month)))))

    def tried(t: Column) -> Column:
        shape, fmt = DATE_SHAPES[0]
        out = F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(fmt)))
        for shape, fmt in DATE_SHAPES[1:]:
            parsed = F.try_to_timestamp(t, F.lit(fmt))
            if "MMMM" in fmt:  # "May" is its own short form
                parsed = F.coalesce(parsed, F.try_to_timestamp(t, F.lit(fmt.replace("MMMM", "MMM"))))
            out = out.when(t.rlike(shape), parsed)
        return out

    return let(spelled, tried)


def parse_timestamp(text: Column) -> Column:
    """Timestamp for any of ``DATE_SHAPES``, else null. Only text that looks like a date is tried."""
    return F.when(text.rlike(r"^[A-Za-z\d][A-Za-z\d ,:./+-]{3,39}$") & text.rlike(r"\d"), _read_shape(text))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_date(text: Column) -> Column:
    """ISO-8601 UTC text when the date can be read, else the text itself."""
    return F.coalesce(iso_utc(parse_timestamp(text)), text)


# -- URLs ---------------------------------------------------------------------

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$"


def host_of(url: Column) -> Column:
    """Host name of an absolute URL, lower case, without user and port; '' otherwise."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def _percent_encode(text: Column) -> Column:
    def one(c: Column) -> Column:
        return (F.when(c == " ", F.lit("%20"))
                .when(c.rlike(r'[^\x21-\x7E]|["<>`{}]'), F.url_encode(c)).otherwise(c))

    encoded = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0)), one), "")
    return F.when(text.rlike(r'[^\x21-\x7E]|["<>`{}]'), encoded).otherwise(text)


def _resolve_dots(path: Column) -> Column:
    def step(done: Column, part: Column) -> Column:
        return (F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                .when(part == ".", done).otherwise(F.concat(done, F.array(part))))

    parts = F.split(F.regexp_replace(path, r"^/", ""), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    rebuilt = let(kept, lambda k: F.concat(
        F.lit("/"), F.array_join(k, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(k) > 0), "/").otherwise("")))
    return F.when(path.rlike(r"/\.\.?(/|$)"), rebuilt).otherwise(path)


def _canonical_url(url: Column) -> Column:
    """Lower-case origin without default port, no dot segments, percent-encoded path and query."""
    def whole(p: Column) -> Column:
        origin = F.regexp_replace(F.regexp_replace(p["origin"], r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
        path = F.when(p["path"] == "", F.when(p["origin"].rlike("^(https?|ftp|wss?):"), "/").otherwise("")).otherwise(
            _percent_encode(_resolve_dots(p["path"])))
        return F.concat(origin, path, _percent_encode(p["rest"]))

    parts = F.struct(F.lower(F.regexp_extract(url, _SPLIT, 1)).alias("origin"),
                     F.regexp_extract(url, _SPLIT, 2).alias("path"), F.regexp_extract(url, _SPLIT, 3).alias("rest"))
    return F.when(url.rlike(_ORIGIN), let(parts, whole)).otherwise(url)


def _join_url(ref: Column, base: Column) -> Column:
    def joined(b: Column) -> Column:
        folder = F.regexp_replace(b["path"], r"[^/]*$", "")
        return (
            F.when(b["origin"] == "", None)
            .when(ref.startswith("//"), F.concat(F.regexp_extract(b["origin"], r"^([^:]*:)", 1), ref))
            .when(ref.startswith("/"), F.concat(b["origin"], ref))
            .when(ref.startswith("?"), F.concat(b["origin"], F.when(b["path"] == "", "/").otherwise(b["path"]), ref))
            .when(ref.startswith("#") | (ref == ""), F.concat(F.regexp_replace(base, r"#.*$", ""), ref))
            .otherwise(F.concat(b["origin"], F.when(folder == "", "/").otherwise(folder), ref)))

    parts = F.struct(F.regexp_extract(base, _ORIGIN, 1).alias("origin"), F.regexp_extract(base, _SPLIT, 2).alias("path"))
    return F.when(ref.rlike(_SCHEME), ref).when(base.isNotNull(), let(parts, joined))


def resolve_url(ref: Column, base: Column) -> Column:
    """Absolute URL of ``ref`` seen from ``base``; ``ref`` itself when that is impossible."""
    return let(F.trim(ref), lambda r: F.coalesce(let(_join_url(r, base), _canonical_url), r))


# -- serialisation and fingerprints -------------------------------------------


_EXPONENT = r"^(-?)(\d)\.(\d+)E(-?\d+)$"


def number_text(num: Column) -> Column:
    """A double printed with the fewest digits that tell it apart, without exponent: ``12``, ``1234.5``."""
    def plain(s: Column) -> Column:
        digits = F.concat(F.regexp_extract(s, _EXPONENT, 2), F.regexp_replace(F.regexp_extract(s, _EXPONENT, 3), "0+$", ""))
        point = F.regexp_extract(s, _EXPONENT, 4).try_cast("int") + 1

        def moved(d: Column) -> Column:
            size = F.length(d)
            return (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d))
                    .when(point >= size, F.concat(d, F.repeat(F.lit("0"), point - size)))
                    .otherwise(F.concat(F.substr(d, F.lit(1), point), F.lit("."), F.substr(d, point + 1))))

        return F.when(s.rlike(_EXPONENT), F.concat(F.regexp_extract(s, _EXPONENT, 1), let(digits, moved))).otherwise(
            F.regexp_replace(s, r"\.0$", ""))

    return F.when(num == 0, F.lit("0")).otherwise(let(num.cast("string"), plain))


def serialize(value: Column, kind: str) -> Column:
    """Text form of a value: '' for null, arrays joined by ' | '. ``kind``: str, num or arr."""
    if kind == "arr":
        return F.coalesce(F.array_join(value, " | "), F.lit(""))
    return F.coalesce(number_text(value) if kind == "num" else value, F.lit(""))


def serialize_value(value: Column) -> Column:
    """Text form of a VALUE struct."""
    return F.coalesce(value["str"], number_text(value["num"]), F.array_join(value["arr"], " | "), F.lit(""))


def json_text(text: Column) -> Column:
    quoted = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def json_value(value: Column) -> Column:
    """JSON of a VALUE struct: string, number, array of strings, or null."""
    return (F.when(value["arr"].isNotNull(), F.to_json(value["arr"]))
            .when(value["num"].isNotNull(), number_text(value["num"]))
            .otherwise(json_text(value["str"])))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as a bigint."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("...."), F.lit(0)),
                        lambda u: F.conv(u, 16, 10).cast("bigint"))
    return F.aggregate(units, F.lit(2166136261).cast("bigint"),
                       lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295)))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def short_hash(text: Column) -> Column:
    """The 32-bit hash in base 36, as used in short ids."""
    return base36(fnv1a32(text))


def fingerprint(content: Column, method: str = "sha256") -> Column:
    """Identity of a record's content. ``method='fnv'`` gives the short 32-bit form, which
    collides once in a few billion pairs; the default does not."""
    return short_hash(content) if method == "fnv" else F.sha2(content, 256)


def csv_safe(text: Column) -> Column:
    """One quoted CSV cell; a cell that a spreadsheet would run as a formula gets a leading quote."""
    inert = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.regexp_replace(inert, '"', '""'), F.lit('"'))


# -- patterns -------------------------------------------------------------------


def has_group(pattern: Column) -> Column:
    """Does a pattern capture anything, by number or by name? Escaped signs and classes are left aside."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"(?s)\\.", "e"), r"\[\^?\]?[^\]]*\]", "c")
    return bare.rlike(r"\((?!\?)|\(\?<[A-Za-z]")


def matches_of(text: Column, full: Column, grouped: Column) -> Column:
    """For every match group 1, or the whole match where there is no group or it took no part."""
    whole = F.regexp_extract_all(text, full, F.lit(0))
    inner = F.zip_with(whole, F.regexp_extract_all(text, full, F.lit(1)), lambda w, g: F.when(g == "", w).otherwise(g))
    return F.when(grouped, inner).otherwise(whole)


def pattern_all(text: Column, pattern: str, flags: str = "iu") -> Column:
    """Group 1 (else the whole) of every match, in order."""
    return matches_of(text, F.lit(f"(?{flags}){pattern}" if flags else pattern), has_group(F.lit(pattern)))


def pattern_first(text: Column, pattern: str, flags: str = "iu") -> Column:
    """Group 1 (else the whole) of the first match, '' when there is none."""
    full = f"(?{flags}){pattern}" if flags else pattern
    whole = F.regexp_extract(text, full, 0)
    inner = F.coalesce(text_or_null(F.regexp_extract(text, full, 1)), whole)
    return F.when(has_group(F.lit(pattern)), inner).otherwise(whole)


def title_case(text: Column) -> Column:
    """``someName``, ``some-name`` and ``some_name`` as ``Some Name``."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2"), r"[_-]+", " ")
    pieces = F.regexp_extract_all(spaced, F.lit(r"\w+|\W+"), F.lit(0))
    capital = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20)))
    return F.trim(F.array_join(capital, ""))


# -- typed values ------------------------------------------------------------------


def typed_value(text: Column, type_: Column, base: Column) -> Column:
    """VALUE struct of one whitespace-normalised text under a field type held in a column."""
    def typed(t: Column) -> Column:
        numeric = type_.isin("number", "price")
        as_text = F.when(type_.isin("url", "image"), resolve_url(t, base)).when(
            type_ == "date", parse_date(t)).otherwise(t)
        return F.struct(
            F.when((t != "") & ~numeric, as_text).alias("str"),
            F.when((t != "") & numeric, parse_number(t)).alias("num"),
            F.lit(None).cast("array<string>").alias("arr"))

    return let(text, typed)
