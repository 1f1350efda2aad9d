"""Column and level name rules, and the compact text forms of numbers."""

from __future__ import annotations

import re
from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies results depend on.
UNIT_WORDS = (
    "donor", "mouse", "patient", "subject", "sample", "replicate", "animal", "individual",
    "orig_ident", "orig.ident", "biosample", "specimen", "participant", "rat", "pig", "hashtag", "hto",
)
GROUPING_WORDS = (
    "condition", "stim", "treat", "treatment", "perturb", "perturbation", "guide", "grna", "sgrna",
    "genotype", "drug", "group", "target", "ko", "kd", "knockdown", "knockout", "disease", "status",
    "timepoint", "time_point", "dose", "stimulation", "arm", "cohort", "response",
)
NUISANCE_WORDS = (
    "batch", "lane", "run", "chemistry", "date", "10x", "plate", "well", "flowcell", "pool", "library",
    "chip", "seq", "sequencing", "processing", "day", "machine", "site", "center", "protocol", "version",
    "kit", "channel",
)
COVARIATE_WORDS = (
    "n_genes", "n_counts", "total_counts", "pct", "percent", "mito", "ribo", "n_features", "ncount",
    "nfeature", "doublet", "score", "complexity", "log1p", "n_umi", "umi", "gene_count",
)
DERIVED_WORDS = (
    "leiden", "louvain", "kmeans", "cluster", "seurat_clusters", "celltype", "cell_type", "cell.type",
    "annotation", "subcluster", "sub_cluster", "phenograph", "cell_state", "celltype_annotation",
)
CYCLE_WORDS = ("phase", "cell_cycle", "cellcycle", "s_score", "g2m", "cc_phase")
DEMOGRAPHIC_WORDS = ("sex", "gender", "age", "ethnicity", "race", "bmi")
BARCODE_WORDS = ("barcode", "cell_id", "cellid", "cell_barcode", "index", "obs_names")
CONTROL_WORDS = (
    "nt", "non-targeting", "nontargeting", "non_targeting", "control", "ctrl", "ctl", "vehicle", "veh",
    "saline", "dmso", "unstim", "unstimulated", "untreated", "wt", "wildtype", "wild-type", "mock",
    "scramble", "scrambled", "baseline", "ref", "reference",
)
STATISTIC_NAMES = (
    "pval", "pvalue", "p_val", "pvals", "p_value", "padj", "pvals_adj", "p_adj", "qval", "qvalue", "fdr",
    "log2foldchange", "logfoldchanges", "logfc", "lfc", "stat", "statistic", "score", "scores", "basemean",
    "adj_pval", "adjpval", "wald_stat", "t_stat", "z",
)
GENE_COLUMN_NAMES = (
    "gene", "genes", "gene_name", "gene_names", "gene_id", "gene_ids", "names", "name", "symbol", "symbols",
    "feature", "features", "gene_symbol", "gene_symbols", "var_names",
)


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def norm_name(name: str) -> str:
    return re.sub(r"[.\- ]", "_", str(name).strip().lower())


def norm_name_col(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), ".- ", "___")


def hits(name: str, words: tuple[str, ...], tokens_only: bool = False) -> bool:
    """A vocabulary word equals a name token, or (by default) occurs inside the name."""
    tokens = set(name.split("_"))
    return any(w in tokens or (not tokens_only and w in name) for w in words)


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def hits_col(c: Column, words: tuple[str, ...]) -> Column:
    """The same rule on a column of normalised names (substring covers the token case)."""
    return c.rlike(_any_of(words))


def is_control(level: str) -> bool:
    low = str(level).strip().lower()
    return low.startswith(CONTROL_WORDS) or bool(set(low.split("_")) & set(CONTROL_WORDS))


def is_control_col(c: Column) -> Column:
    words = _any_of(CONTROL_WORDS)
    return F.lower(F.trim(c)).rlike(f"^({words})|_({words})(_|$)")


def unit_noun(name: str) -> str:
    """`donor_id` reads as `donor` in a sentence."""
    out = re.sub(r"(_id|_label|_name|id)$", "", str(name).lower()).strip("_")
    return out or str(name)


def unit_noun_col(c: Column) -> Column:
    out = F.trim(F.lit("_"), F.regexp_replace(F.lower(c), "(_id|_label|_name|id)$", ""))
    return F.when(out == "", c).otherwise(out)


P_FLOOR = 1e-300


def neg_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(P_FLOOR)))


def p_text(p: Column) -> Column:
    """Compact p-value text; the number always travels beside it."""
    return (
        F.when(p.isNull(), F.lit("n/a"))
        .when(p <= P_FLOOR, F.lit("<1e-300"))
        .when(p < 1e-4, F.format_string("%.1e", p))
        .when(p < 1e-3, F.format_string("%.2e", p))
        .otherwise(F.format_string("%.3g", p))
    )


def percent_text(x: Column) -> Column:
    return F.concat(F.round(x * 100).cast("long").cast("string"), F.lit("%"))


def p_words(p: float | None) -> str:
    if p is None:
        return "n/a"
    if p <= P_FLOOR:
        return "<1e-300"
    return f"{p:.1e}" if p < 1e-4 else f"{p:.2e}" if p < 1e-3 else f"{p:.3g}"
