"""Case manifests: three JSON shapes, field aliases, and per-case knob overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted names of each manifest field.
ALIASES = {
    "case_id": ("case_id", "caseId", "case", "id"),
    "foil": ("foil", "h5ad", "path", "file", "filename"),
    "unit": ("unit", "unit_col", "unitCol"),
    "grouping": ("grouping", "group", "grouping_col", "groupingCol"),
    "nuisance": ("nuisance", "nuisance_col", "nuisanceCol", "technical"),
    "state_col": ("state_col", "stateCol", "cell_state_col", "cellStateCol"),
    "focus_gene": ("focus_gene", "focusGene", "gene"),
    "spurious": ("spurious", "spurious_group", "spuriousGroup", "tracked"),
    "stable": ("stable", "stable_group", "stableGroup"),
    "markers": ("markers", "marker_genes", "markerGenes"),
    "cluster_method": ("cluster_method", "clusterMethod", "method"),
}
NUMERIC_ALIASES = {
    "markers_k": ("markers_k", "markersK", "n_markers", "nMarkers"),
    "split": ("split", "eps"),
    "alpha": ("alpha",),
    "res_min": ("res_min", "resMin", "min"),
    "res_max": ("res_max", "resMax", "max"),
    "res_step": ("res_step", "resStep", "step"),
    "seed": ("seed",),
    "min_coverage": ("min_coverage", "minCoverage", "coverage"),
    "min_purity": ("min_purity", "minPurity", "purity"),
    "stable_fraction": ("stable_fraction", "stableFraction"),
}
REQUIRED = ("case_id", "foil", "unit", "grouping", "nuisance", "state_col", "focus_gene", "spurious")


def read_cases(spark: SparkSession, path: str, defaults: dict[str, float] | None = None) -> DataFrame:
    """One row per case with canonical fields; `error` names what a malformed case lacks.

    The file may be a bare list, an object with a `cases` list, or an object keyed by case.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))
    body = "map<string,string>"
    shape = F.substring(F.ltrim("doc"), 1, 1)
    listed = F.get_json_object("doc", "$.cases")
    bare = F.from_json(F.when(shape == "[", F.col("doc")), f"array<{body}>")
    nested = F.from_json(listed, f"array<{body}>")
    keyed = F.transform(
        F.map_entries(F.from_json(F.when((shape == "{") & listed.isNull(), F.col("doc")), f"map<string,{body}>")),
        lambda e: F.map_concat(
            F.create_map(F.lit("caseId"), e["key"]), F.map_filter(e["value"], lambda k, _: k != "caseId")
        ),
    )
    cases = text.select(F.posexplode(F.coalesce(bare, nested, keyed)).alias("pos", "c"))
    def pick(names):
        return F.coalesce(*[F.col("c")[a] for a in names])

    fields = [pick(names).alias(field) for field, names in ALIASES.items() if field != "markers"]
    raw = pick(ALIASES["markers"])
    listed_markers = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(
        F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    )
    knobs = [
        F.coalesce(pick(names).try_cast("double"), F.lit((defaults or {}).get(k)).cast("double")).alias(k)
        for k, names in NUMERIC_ALIASES.items()
    ]
    out = cases.select("pos", *fields, listed_markers.alias("markers"), *knobs)
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED]))
    return out.withColumn("error", F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.concat_ws(", ", missing))))
