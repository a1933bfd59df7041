"""Cell-level text functions: blanks, lists, identifiers, payloads, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplewright.model import PLACEHOLDER_MARKERS

_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
PAYLOAD_TYPE = "map<string,string>"
ACCESSION_URL = "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc="  # fixed value


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all white space, tabs and line ends included (`trim` alone takes spaces only)."""
    return F.btrim(_col(c).cast("string"), F.lit(_SPACES))


def norm(c: Column | str) -> Column:
    """Null becomes the empty string, anything else is trimmed."""
    return F.coalesce(strip(c), F.lit(""))


def filled(c: Column | str) -> Column:
    """The trimmed cell, or null when it is blank."""
    s = strip(c)
    return F.when(s != "", s)


def is_blank(c: Column | str) -> Column:
    return norm(c) == ""


def split_list(c: Column | str, sep: str = ";") -> Column:
    """A delimited cell as an array of trimmed, non-blank entries."""
    parts = F.split(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit(sep))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def mint_uid(sampletype, lab, date, n) -> Column:
    """`TYPE-YYMMDDLAB-N`, counted from 1, no padding."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.concat(as_col(sampletype), F.lit("-"), as_col(date), as_col(lab), F.lit("-"), as_col(n).cast("string"))


def uid_type(c: Column | str) -> Column:
    """The type prefix of a UID, null when the text holds no hyphen."""
    uid = _col(c)
    return F.when(F.contains(uid, F.lit("-")), F.substring_index(uid, "-", 1))


def uid_index(c: Column | str, sampletype: Column, lab: str, date: str) -> Column:
    """The counter of a UID of exactly this type, date and lab, else null (suffixed UIDs do not count)."""
    uid = _col(c)
    prefix = F.concat(sampletype, F.lit(f"-{date}{lab}-"))
    rest = F.substr(uid, F.length(prefix) + 1)
    return F.when(F.startswith(uid, prefix) & rest.rlike("^[0-9]+$"), rest.try_cast("bigint"))


def has_type(c: Column | str, prefixes: list[str]) -> Column:
    """Row filter on UID prefixes such as `D.SEQ-`."""
    return reduce(lambda a, b: a | b, [F.startswith(_col(c), F.lit(p + "-")) for p in prefixes])


def summary(c: Column | str, width: int = 80) -> Column:
    """The first `width` characters, with an ellipsis when something was cut."""
    text = F.coalesce(_col(c), F.lit(""))
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def payload(c: Column | str) -> Column:
    """A JSON payload as a string map. Null for blank, malformed and non-object text. Of a key given twice the last value counts.

    The text is parsed as the one element of a list, since the parser would overlook text after a bare object.
    """
    whole = F.concat(F.lit("["), filled(c), F.lit("]"))
    items = F.from_json(whole, f"array<{PAYLOAD_TYPE}>", {"allowSingleQuotes": "false"})
    one = F.filter(F.array(items), lambda x: F.size(x) == 1)  # binds the parse result, which is then used twice
    found = F.filter(F.array(F.get(F.get(one, F.lit(0)), F.lit(0))), lambda m: m.isNotNull())
    return F.get(F.transform(found, _last_values), F.lit(0))


def _last_values(attrs: Column) -> Column:
    """A parsed map, which has a key as often as the text gave it, with the last value of each key."""
    keys = F.map_keys(attrs)
    pairs = F.map_entries(attrs)
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), attrs).otherwise(F.map_from_entries(last))


def payload_json(attrs: Column | str) -> Column:
    """A string map as compact JSON in key order, without blank entries."""
    return F.to_json(drop_blank(attrs))


def drop_blank(attrs: Column | str) -> Column:
    return F.map_filter(_col(attrs), lambda _, v: v.isNotNull() & (v != ""))


def attr(attrs: Column | str, key: str) -> Column:
    """A payload field, null when absent."""
    return F.try_element_at(_col(attrs), F.lit(key))


def parent_cell(parent: Column | str, attrs: Column | str) -> Column:
    """The parent cell, else the payload's `Parent`, else null."""
    return F.coalesce(filled(parent), filled(attr(attrs, "Parent")))


def holds_any(c: Column | str, markers: list[str] = PLACEHOLDER_MARKERS) -> Column:
    """Does the text hold one of the markers? Case counts."""
    return reduce(lambda a, b: a | b, [F.contains(F.coalesce(_col(c), F.lit("")), F.lit(m)) for m in markers])


def marker_count(c: Column | str, marker: str) -> Column:
    """Non-overlapping occurrences of a literal marker."""
    text = F.coalesce(_col(c), F.lit(""))
    gone = F.replace(text, F.lit(marker), F.lit(""))
    return ((F.length(text) - F.length(gone)) / len(marker)).cast("bigint")


def sentinel_flag(c: Column | str, sentinel: str) -> Column:
    return F.contains(F.coalesce(_col(c), F.lit("")), F.lit(sentinel))


def url_type(c: Column | str) -> Column:
    """empty / zenodo / omero / geo / other_url / non_url; the first rule that holds wins."""
    s = F.lower(_col(c))
    return (
        F.when(s.isNull() | (s == ""), "empty")
        .when(F.contains(s, F.lit("zenodo.org")), "zenodo")
        .when(F.contains(s, F.lit("omero")), "omero")
        .when(F.contains(s, F.lit("geo/query")) | F.contains(s, F.lit("ncbi.nlm.nih.gov/geo")), "geo")
        .when(F.startswith(s, F.lit("http")), "other_url")
        .otherwise("non_url")
    )


def archive_url(record: str, zip_name: Column | str) -> Column:
    return F.concat(
        F.lit(f"https://zenodo.org/records/{record}/files/"), _col(zip_name), F.lit("?download=1&preview=1")
    )


def accession_url(accession: Column | str) -> Column:
    return F.concat(F.lit(ACCESSION_URL), _col(accession))


def image_detail_url(base: str, image_id: Column | str, dataset_id: Column | str) -> Column:
    """Detail page of an image, within its data set when there is one."""
    page = F.concat(F.lit(f"{base}/webclient/img_detail/"), _col(image_id).cast("string"), F.lit("/"))
    ds = filled(dataset_id)
    return F.when(ds.isNull() | (ds == "0"), page).otherwise(F.concat(page, F.lit("?dataset="), ds))


def image_show_url(base: str, image_id: Column | str) -> Column:
    return F.concat(F.lit(f"{base}/webclient/?show=image-"), _col(image_id).cast("string"))


def pick_link(web_url: Column | str, show_url: Column | str) -> Column:
    return F.coalesce(filled(web_url), filled(show_url))


# Donor and spatial identifiers inside titles and cells.
ROSTER_PATTERNS = (r"_(D\d+)\s*$", r"\((D\d{2}-\d{4})\)")
BULK_ID = r"D\d+"
SPATIAL_ID = r"D\d{2}-\d{4}"


def roster_id(title: Column | str) -> Column:
    """The sample id a roster title ends in or holds in brackets; null when there is none."""
    hits = [F.regexp_extract(_col(title), p, 1) for p in ROSTER_PATTERNS]
    return F.coalesce(*[F.when(h != "", h) for h in hits])


def first_hit(c: Column | str, pattern: str) -> Column:
    """The first match of a pattern in a cell, else null."""
    hit = F.regexp_extract(_col(c), pattern, 0)
    return F.when(hit != "", hit)


def fold_text(c: Column | str) -> Column:
    """A cell without case and white space: equal folds mean a difference of format only."""
    return F.lower(F.regexp_replace(norm(c), r"\s+", ""))


def drop_suffixes(c: Column | str, suffixes: list[str]) -> Column:
    """Remove known noise suffixes, one after another."""
    out = _col(c)
    for s in suffixes:
        out = F.when(F.endswith(out, F.lit(s)), F.left(out, F.length(out) - len(s))).otherwise(out)
    return out


def candidate_ids(c: Column | str, years: list[str], suffixes: list[str]) -> Column:
    """Keys to try for a hand-typed id, best first: as typed, then without suffix noise, then with sibling years."""
    raw = norm(c)
    clean = drop_suffixes(raw, suffixes)
    year, rest = F.regexp_extract(clean, r"^(\d{2})-(.+)$", 1), F.regexp_extract(clean, r"^(\d{2})-(.+)$", 2)
    siblings = F.when(
        year != "",
        F.transform(F.filter(F.array(*map(F.lit, years)), lambda y: y != year), lambda y: F.concat_ws("-", y, rest)),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(raw, clean), siblings))


def header_name(c: str, aliases: dict[str, str]) -> str:
    """Canonical form of a header: trimmed, lower case, aliases resolved."""
    low = c.strip().lower()
    return aliases.get(low, low)


HEADER_ALIASES = {"sample_type": "sampletype", "jsonmetadata": "json_metadata", "assayids": "assay_ids"}  # fixed values


def with_canonical_headers(df, aliases: dict[str, str] = HEADER_ALIASES):
    """Rename all columns to their canonical form; two columns that fold into one are an error."""
    names = [header_name(c, aliases) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"duplicate headers: {', '.join(twice)}")
    return df.toDF(*names)


