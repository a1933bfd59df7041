"""File-tree functions: canonical names, classification of a path, target paths.

The rules are data: each rule is a row of a table below, and a classification is one `when` chain built from
the tables. Everything stays a Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplewright.functions.layers import layer

# Canonical spelling of known words, applied in this order after lower-casing.
KEYWORDS = [
    ("1000TCs", ["1000tcs", "1000-tcs"]),
    ("100TCs", ["100tcs", "100-tcs"]),
    ("TC1000", ["tc1000", "tc-1000"]),
    ("TC100", ["tc100", "tc-100"]),
    ("TC10", ["tc10", "tc-10"]),
    ("MCF7", ["mcf7"]),
    ("MVN", ["mvn"]),
    ("MV3", ["mv3"]),
    ("PM6", ["pm6"]),
    ("DMSO", ["dmso"]),
    ("EGFP", ["egfp"]),
    ("GFP", ["gfp"]),
    ("BFP", ["bfp"]),
    ("RFP", ["rfp"]),
]

# Chamber stems of figure 5 and the tissue stems they belong to.
FIGURE5_CHAMBERS = [
    (r"^231-day9-dev-(\d+)$", "231-day9-gel-dev-$1"),
    (r"^MCF7-day9-dev-(\d+)$", "MCF7-day9-gel-dev-$1"),
    (r"^d9-231-flow-dev-(\d+)$", "d9-MVN-231-flow-dev-$1"),
]

FIGURES = [f"Figure {n}" for n in range(1, 8)]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path: Column | str) -> Column:
    """Last part of a path; back-slashes count as separators too."""
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def stem(name: Column | str) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(_col(name), r"^(.+)\.[^.]+$", "$1")


def suffix(name: Column | str) -> Column:
    """The last suffix of a file name with its dot, in lower case, or the empty string."""
    return F.lower(F.regexp_extract(_col(name), r"^.+(\.[^.]+)$", 1))


def normalize_stem(c: Column | str) -> Column:
    """Canonical form of one path part: ASCII, hyphens for separators, lower case but for known words."""
    out = F.regexp_replace(_col(c), r"[^\x00-\x7F]", "")
    out = F.regexp_replace(out, r"[_\s\x1c-\x1f-]+", "-")
    out = F.lower(F.btrim(out, F.lit("-")))
    for canonical, variants in KEYWORDS:
        for v in variants:
            out = F.replace(out, F.lit(v), F.lit(canonical))
    return out


def split_acquisition(c: Column | str) -> Column:
    """struct(stem, acquisition): a trailing `_NNNN` or `-NNNN` taken off, else the text and an empty string."""
    return F.struct(
        F.regexp_replace(_col(c), r"[_-]\d{4}$", "").alias("stem"),
        F.regexp_extract(_col(c), r"[_-](\d{4})$", 1).alias("acquisition"),
    )


def canonical_device_id(figure: Column, raw: Column | str, is_chamber: Column | bool) -> Column:
    """Normalised device id; chamber names of figure 5 are rewritten to their tissue's name."""
    return _rename_chamber(figure, normalize_stem(raw), F.lit(is_chamber) if isinstance(is_chamber, bool) else is_chamber)


def _rename_chamber(figure: Column, name: Column, chamber: Column) -> Column:
    renamed = F.when(F.lit(False), name)
    for pattern, target in FIGURE5_CHAMBERS:
        renamed = renamed.when(name.rlike(pattern), F.regexp_replace(name, pattern, target))
    return F.when((figure == 5) & chamber, renamed.otherwise(name)).otherwise(name)


@dataclass(frozen=True)
class TileRule:
    """A file inside a device folder whose name carries a region and a tile number."""

    pattern: str  # two groups: region, tile; an optional third, first in the text, is a free prefix
    tag: str
    extension: str
    has_prefix: bool = False


# Tile and quantification names inside a device folder, in order of precedence.
TILE_RULES = [
    TileRule(r"(?i)^ROI(\d+)[_-](\d+)\.oib$", "R", "oib"),
    TileRule(r"^(\d+)_(\d+)\.oib$", "T", "oib"),
    TileRule(r"(?i)^(.+?)Bottom left(\d+)_(\d+)\.oib$", "BL", "oib", True),
    TileRule(r"(?i)^ROI(\d+)[_-](\d+)\.oib\.csv$", "R", "csv"),
    TileRule(r"^(\d+)_(\d+)\.oib\.csv$", "T", "csv"),
    TileRule(r"(?i)^(.+?)Bottom left(\d+)_(\d+)\.oib\.csv$", "BL", "csv", True),
]
# Category, storage and sample type of the two tile kinds.
TILE_KINDS = {"oib": ("imaging-tile", "omero", "D.IMG"), "csv": ("quantification", "zenodo", "A.IMG")}

# Single files of a device folder: (name, case-blind?, category, sample type, name tail, note).
FOLDER_FILES = [
    ("matl_mosaic.log", True, "mosaic-log", "", "mosaic.log", "attach as Link_SecondaryData on parent D.IMG row(s)"),
    ("TileConfiguration.txt", False, "stitch-config", "", "tilecfg.txt", "Fiji stitching input"),
    ("TileConfiguration.registered.txt", False, "stitch-config", "", "tilecfg-reg.txt",
     "Fiji stitching output (registered)"),
    ("fused.tif", True, "stitched-image", "A.IMG", "fused.tif", "stitched composite of ROI tiles"),
]

SPEC_FIELDS = [
    "figure", "device_id", "region", "acquisition", "roi", "category", "target_storage", "sampletype",
    "target_filename", "skip_reason", "notes",
]


def _spec(figure, category, storage, sampletype="", filename="", device="", region="na", acquisition="", roi="",
          skip="", notes="") -> Column:
    values = [figure, device, region, acquisition, roi, category, storage, sampletype, filename, skip, notes]
    cols = [v if isinstance(v, Column) else F.lit(v) for v in values]
    cols[0] = cols[0].cast("int")
    return F.struct(*[c.alias(n) for c, n in zip(cols, SPEC_FIELDS)])


def _skip(figure, category, reason) -> Column:
    return _spec(figure, category, "skip", skip=reason)


def classify_paths(df, path: str = "path"):
    """Add the classification of each relative path as the columns of `SPEC_FIELDS`.

    Derived parts and the classification itself are layers, so a filter on a result column never copies the rules into
    itself: every rule is evaluated once per row.
    """
    kept = df.columns
    df = layer(df, _p=F.split(F.col(path), "/"))
    df = layer(
        df,
        _n=F.size("_p"),
        _top=F.get("_p", F.lit(0)),
        _sub=F.get("_p", F.lit(1)),
        _name=F.element_at("_p", -1),
        _fig=F.regexp_extract(F.get("_p", F.lit(0)), r"^Figure (\d+)$", 1).try_cast("int"),
    )
    acq = split_acquisition("_sub")
    df = layer(
        df,
        _low=F.lower("_name"),
        _two=F.coalesce(F.col("_fig").isin(3, 4, 5, 7), F.lit(False)),
        _nstem=normalize_stem(stem("_name")),
        _acq=F.when(acq["acquisition"] != "", acq["acquisition"]).otherwise("0001"),
        _raw=normalize_stem(acq["stem"]),
        _tile=_first_tile(F.col("_name")),
    )
    df = layer(df, _ndev=_rename_chamber(F.col("_fig"), F.col("_raw"), F.lit(True)))
    return df.select(*kept, F.inline(F.array(_classification(path))))


def _first_tile(name: Column) -> Column:
    """struct(roi, extension, prefix) of the first tile rule that fits, else null."""
    chain = None
    for rule in TILE_RULES:
        first = 2 if rule.has_prefix else 1
        hit = F.struct(
            F.concat(
                F.lit(rule.tag), F.regexp_extract(name, rule.pattern, first), F.lit("_"),
                F.regexp_extract(name, rule.pattern, first + 1),
            ).alias("roi"),
            F.lit(rule.extension).alias("extension"),
            (F.trim(F.regexp_extract(name, rule.pattern, 1)) if rule.has_prefix else F.lit("")).alias("prefix"),
        )
        chain = F.when(name.rlike(rule.pattern), hit) if chain is None else chain.when(name.rlike(rule.pattern), hit)
    return chain


def _in_device_folder() -> Column:
    """Classification of `Figure N/<device folder>/<file>`; null when no rule fits."""
    fig, name, low, tile = F.col("_fig"), F.col("_name"), F.col("_low"), F.col("_tile")
    head = F.concat(F.col("_ndev"), F.when(F.col("_two"), "_c").otherwise("_a"), F.col("_acq"), F.lit("_"))
    common = dict(
        figure=fig, device=F.col("_ndev"), region=F.when(F.col("_two"), "chamber").otherwise("na"),
        acquisition=F.col("_acq"),
    )
    chain = None
    for ext, (category, storage, sampletype) in TILE_KINDS.items():
        note = F.when(tile["prefix"] != "", F.concat(F.lit("original tile prefix: '"), tile["prefix"], F.lit("'")))
        hit = _spec(
            category=category, storage=storage, sampletype=sampletype, roi=tile["roi"],
            filename=F.concat(head, tile["roi"], F.lit("." + ext)), notes=F.coalesce(note, F.lit("")), **common,
        )
        when = tile["extension"] == ext
        chain = F.when(when, hit) if chain is None else chain.when(when, hit)
    chain = chain.when(
        F.endswith(low, F.lit(".oib")) & (F.col("_nstem") == F.col("_raw")),
        _spec(category="stitched-image", storage="zenodo", sampletype="A.IMG",
              filename=F.concat(head, F.lit("chamber-fused.oib")),
              notes="FluoView-stitched composite saved under device name", **common),
    )
    for text, blind, category, sampletype, tail, note in FOLDER_FILES:
        chain = chain.when(
            (low if blind else name) == text,
            _spec(category=category, storage="zenodo", sampletype=sampletype, filename=F.concat(head, F.lit(tail)),
                  notes=note, **common),
        )
    return chain


def _classification(path: str) -> Column:
    fig, n, top, sub, name, low = (F.col(c) for c in ("_fig", "_n", "_top", "_sub", "_name", "_low"))
    nstem, third = F.col("_nstem"), F.get(F.col("_p"), F.lit(2))
    folder = _in_device_folder()
    tissue = nstem
    ext = suffix(name)
    ends = lambda e: F.endswith(low, F.lit(e))
    storm = (fig == 6) & (n >= 3) & sub.isin("ImgLib", "STORMLib")
    area = (fig == 2) & (n >= 3) & (sub == "TC area over time")
    velocity = r"(?i)^Fused-dev-(\d+)\.tif$"
    return (
        F.when((top == "Figure 2") & (n == 2) & F.startswith(low, F.lit("movie")) & ends(".tif"),
               _skip(2, "excluded-movie", "excluded from submitted manuscript"))
        .when((top == "Figure 7") & (n >= 2) & sub.rlike("^Figure [1-6]$"),
              _skip(7, "duplicate", F.concat(F.lit("byte-identical mirror of top-level "), sub)))
        .when(fig.isNull(), _skip(0, "unknown", F.concat(F.lit("not under Figure N: "), F.col(path))))
        .when((fig == 1) & (name == "intrav_sim_final.mph"),
              _spec(1, "comsol-model", "zenodo", "MDL", "intrav_sim_final.mph"))
        .when(fig == 1, _skip(1, "unknown", "unexpected file under Figure 1"))
        .when(storm & ends(".png"),
              _spec(6, "storm-density", "zenodo", "A.IMG", name,
                    notes=F.concat(F.lit("STORM density map ("), sub, F.lit(")"))))
        .when(storm & ends(".txt"),
              _spec(6, "storm-coords", "zenodo", "A.IMG", name,
                    notes=F.concat(F.lit("STORM coordinates ("), sub, F.lit(")"))))
        .when(fig == 6, _skip(6, "unknown", "unexpected file under Figure 6"))
        .when((fig == 2) & (n >= 3) & (sub == "velocity sims") & name.rlike(velocity),
              _spec(2, "velocity-sim", "zenodo", "D.SIM",
                    F.concat(F.lit("velsim-dev-"), F.regexp_extract(name, velocity, 1), F.lit(".tif")),
                    notes="muVes simulation output"))
        .when(area & (n == 3) & ends(".oib"),
              _spec(2, "tc-area", "omero", "D.IMG", F.concat(F.lit("tc-area-"), nstem, F.lit(".oib")), device=nstem))
        .when(area & (n == 4) & third.isin("d1", "d4", "d5") & ends(".tif"),
              _spec(2, "tc-area-early", "omero", "D.IMG",
                    F.concat(F.lit("tc-area-"), third, F.lit("-"), nstem, F.lit(".tif")), device=nstem,
                    notes=F.concat(F.lit("early timepoint "), third)))
        .when(F.col("_two") & (n == 2) & ext.isin(".oib", ".tif"),
              _spec(fig, "imaging-raw", "omero", "D.IMG", F.concat(tissue, F.lit("_t"), ext), device=tissue,
                    region="tissue"))
        .when(((fig == 2) | F.col("_two")) & (n == 3) & folder.isNotNull(), folder)
        .otherwise(_skip(fig, "unknown", F.concat(F.lit("unrecognized pattern: "), F.col(path))))
    )


def target_relpath(figure: Column | str, filename: Column | str, storage: Column | str) -> Column:
    """Where a file goes: the figure folder, or its `- secondary` neighbour for archive files."""
    fig, name, kind = _col(figure).cast("string"), _col(filename), _col(storage)
    return (
        F.when((name != "") & (kind == "omero"), F.concat(F.lit("Figure "), fig, F.lit("/"), name))
        .when((name != "") & (kind == "zenodo"), F.concat(F.lit("Figure "), fig, F.lit(" - secondary/"), name))
        .otherwise("")
    )


def figure_of(path: Column | str) -> Column:
    """Figure number of a path under `Figure N/`, null when there is none."""
    return F.regexp_extract(_col(path), r"^Figure\s+([^\s/]+)(\s[^/]*)?/", 1).try_cast("int")


def already_staged(path: Column | str) -> Column:
    return F.concat(F.lit("/"), _col(path)).rlike(r"/Figure\d+_[A-Z.]+/")


def staged_path(figure: Column, sampletype: Column | str, name: Column | str) -> Column:
    fig = figure.cast("string")
    return F.concat(F.lit("Figure "), fig, F.lit("/Figure"), fig, F.lit("_"), _col(sampletype), F.lit("/"), _col(name))
