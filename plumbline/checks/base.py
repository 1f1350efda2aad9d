"""What a check is, what it returns, and the rows findings become."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.dataset import Claim, Dataset, Design, case_key
from plumbline.functions.labels import column
from plumbline.session import hold

BY = ["case_id"]
CLEAN, FLAGGED, FLAG_ONLY, HARD_STOP = "clean", "flagged", "flag_only", "hard_stop"
STATES = (CLEAN, FLAGGED, FLAG_ONLY, HARD_STOP)
FIXABLE, NEEDS_DATA, UNSALVAGEABLE = "fixable_now", "needs_new_data", "unsalvageable"
DETAIL_ROWS = 500  # rows of a detail shown on the chart; the whole detail is a table beside the finding


@dataclass
class Finding:
    check_id: int
    state: str
    headline: str
    original: float | None = None
    corrected: float | None = None
    feasibility: str = FIXABLE
    engine: str = ""
    target: str = ""
    numbers: dict[str, float] = field(default_factory=dict)
    charts: dict[str, dict] = field(default_factory=dict)
    details: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.state not in STATES:
            raise ValueError(f"state must be one of {STATES}")
        if self.feasibility == UNSALVAGEABLE and self.corrected is not None:
            raise ValueError("a finding that cannot be rescued shows no corrected number")

    @property
    def unsalvageable(self) -> bool:
        return self.feasibility == UNSALVAGEABLE


class Check:
    """One check: where it applies, and how to run it."""

    id: int
    kinds: tuple[str, ...] = ()

    def applies_to(self, claim: Claim, design: Design) -> bool:
        raise NotImplementedError

    def run(self, ds: Dataset, design: Design, claim: Claim) -> Finding:
        raise NotImplementedError

    def kind_fits(self, claim: Claim, unknown_passes: bool) -> bool:
        return claim.kind in self.kinds or (unknown_passes and claim.kind in ("", "unknown"))


def _level(name):
    return T.StructField(
        name,
        T.StructType([T.StructField("n", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("sig", T.BooleanType())]),
    )


def _rows(name, **fields):
    return T.StructField(name, T.ArrayType(T.StructType([T.StructField(k, t()) for k, t in fields.items()])))


D, S, B, I = T.DoubleType, T.StringType, T.BooleanType, T.LongType
_CHARTS = {
    "significance": [
        _level("naive"),
        _level("honest"),
        T.StructField("alpha", D()),
        T.StructField("bad_unit", B()),
        _rows("units", id=S, group=S, n=I, value=D),
    ],
    "hard_stop": [T.StructField("units", I()), T.StructField("per_group", I())],
    "groups": [
        _rows("markers", gene=S, disc=D, hold=D),
        T.StructField("split", D()),
        T.StructField("disc_auc", D()),
        T.StructField("hold_auc", D()),
    ],
    "fragility": [
        _rows("steps", r=D, present=B, clusters=I, score=D),
        T.StructField("track", S()),
        T.StructField("stability", D()),
        T.StructField("chosen", D()),
        T.StructField("supported", T.ArrayType(D())),
    ],
    "confound": [_rows("grid", a=S, b=S, n=I), T.StructField("v", D())],
    "volcano": [_rows("points", gene=S, log2fc=D, neg_log10_p=D, sig=B, claimed=B), T.StructField("n_sig", I())],
    "fdr": [
        _rows("top", gene=S, p=D, q=D, survives=B),
        T.StructField("tests", I()),
        T.StructField("alpha", D()),
        T.StructField("raw_hits", I()),
        T.StructField("adjusted_hits", I()),
        T.StructField("method", S()),
    ],
}
CHART_KINDS = tuple(_CHARTS)
FINDINGS = T.StructType(
    [
        T.StructField("case_id", S()),
        T.StructField("check_id", T.IntegerType()),
        T.StructField("state", S()),
        T.StructField("headline", S()),
        T.StructField("original", D()),
        T.StructField("corrected", D()),
        T.StructField("unsalvageable", B()),
        T.StructField("feasibility", S()),
        T.StructField("engine", S()),
        T.StructField("target", S()),
        T.StructField("numbers", T.MapType(S(), D())),
        *[T.StructField(k, T.StructType(f)) for k, f in _CHARTS.items()],
    ]
)


def _shape(dtype, value):
    """Python values laid out for a schema; absent keys become null."""
    if value is None:
        return None
    if isinstance(dtype, T.StructType):
        return tuple(_shape(f.dataType, value.get(f.name)) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return [_shape(dtype.elementType, v) for v in value]
    if isinstance(dtype, T.DoubleType):
        return float(value)
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return int(value)
    return value


def findings_frame(spark: SparkSession, findings: list[Finding], case_id: str = "case") -> DataFrame:
    """A handful of finding rows; everything heavy behind them was reduced in Spark."""
    rows = []
    for f in findings:
        number = lambda v: None if v is None else float(v)
        head = (
            case_id, f.check_id, f.state, f.headline, number(f.original), number(f.corrected), f.unsalvageable, f.feasibility, f.engine, f.target,
            {k: float(v) for k, v in f.numbers.items() if v is not None},
        )
        rows.append(head + tuple(_shape(T.StructType(_CHARTS[k]), f.charts.get(k)) for k in CHART_KINDS))
    return spark.createDataFrame(rows, FINDINGS)


def significance(n0, p0, n1, p1, alpha, bad_unit=False, units=()) -> dict:
    side = lambda n, p: {"n": n, "p": p, "sig": p is not None and p < alpha}
    return {"naive": side(n0, p0), "honest": side(n1, p1), "alpha": alpha, "bad_unit": bad_unit, "units": list(units)}


def detail(df: DataFrame) -> list[dict]:
    """The first rows of a chart detail; the finding keeps all of them in `details`."""
    return [r.asDict() for r in df.limit(DETAIL_ROWS).collect()]


def details_frame(findings: list[Finding], case_id: str = "case") -> DataFrame | None:
    """Every row behind the charts: (case_id, check_id, detail, row), the row as a map of texts."""
    out = None
    for f in findings:
        for name, df in f.details.items():
            pairs = [x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]
            rows = df.select(F.lit(case_id).alias("case_id"), F.lit(f.check_id).alias("check_id"), F.lit(name).alias("detail"), F.create_map(*pairs).alias("row"))
            out = rows if out is None else out.unionByName(rows)
    return out


def unit_cells(ds: Dataset, group: str, unit: str | None, *extra: str) -> DataFrame:
    """The cell columns a check needs, roles renamed; nothing else is read."""
    cols = [F.col("case_id") if "case_id" in ds.cells.columns else case_key("case", "cell_id").alias("case_id"), F.col("cell_id")]
    cols.append(F.col(group).cast("string").alias("grp"))
    cols.append((F.col(unit) if unit else F.lit("all")).cast("string").alias("unit"))
    if "library" in ds.cells.columns:
        cols.append(F.col("library"))
    cols += [column(e).cast("string").alias(extra_name(e)) for e in dict.fromkeys(extra)]
    return ds.cells.select(*cols)


def extra_name(column_name: str) -> str:
    """Technical columns keep clear of the renamed role columns."""
    return f"x_{column_name}"


def sample_counts(cells: DataFrame) -> DataFrame:
    """Cells per (case, group, unit): arms, replicates and the unit test all read this one table."""
    return hold(cells.groupBy(*BY, "grp", "unit").agg(F.count("*").alias("n_cells")))


def has_column(ds: Dataset, name: str | None) -> bool:
    return bool(name) and name in ds.cells.columns


def count_rows(ds: Dataset) -> DataFrame | None:
    """The raw-count rows of the preferred layer, or None when no layer holds counts."""
    from plumbline.operators.inventory import find_counts

    if ds.counts is None:
        return None
    if "layer" not in ds.located:
        ds.located["layer"] = find_counts(ds.counts).first()["source"]
    source = ds.located["layer"]
    return None if source is None else ds.counts.filter(F.col("layer") == source)
