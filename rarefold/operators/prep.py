"""Feature preparation fitted on the training part only.

Fitted state is three small metadata tables:

* ``spec(feature, kind, position, cardinality)``
* ``numeric_stats(feature, fill, mean, std)``
* ``categories(feature, value, code)``

Every fit statistic is one aggregate over all columns (never a job per
column). Dictionaries up to ``MAP_LIMIT`` entries are applied as map literals
inside the projection; larger ones by joins whose broadcast is size-checked.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.functions.prefix import global_row_number
from rarefold.functions.quantile import exact_quantiles
from rarefold.session import staged

log = logging.getLogger(__name__)

NUMERIC, CATEGORICAL, DROPPED = "numeric", "categorical", "dropped"
# Fixed values of the reference's preparation
UNKNOWN = "__unknown__"
DEFAULT_LOW_CARDINALITY = 20
DEFAULT_MAX_CATEGORICAL_CARDINALITY = 100
DEFAULT_NUMERIC_FILL = -999.0
DEFAULT_CATEGORICAL_FILL = "missing"

MAP_LIMIT = 32  # dictionary entries of a column embedded as literals (a map literal is searched from end to end)
BROADCAST_BYTES = 8 << 20  # a column's dictionary is broadcast up to here; beyond, Spark picks the join at run time


@dataclass(frozen=True)
class Roles:
    target: str
    id: str | None = None
    time: str | None = None
    drop: tuple[str, ...] = ()

    def excluded(self) -> set[str]:
        return set(self.drop) | {self.target} | ({self.id} if self.id else set()) | ({self.time} if self.time else set())


def _is_numeric(dt) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def _clean_num(c: Column, dt) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None).cast(dt))
    return c


def canonical_string(c: Column, dt) -> Column:
    """Category value as a string; integral floats print as integers so that a
    column read as int and as double (with nulls) gives the same code."""
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        integral = (d == F.floor(d)) & (F.abs(d) < F.lit(9.0e18))
        return F.when(integral, d.cast("long").cast("string")).otherwise(d.cast("string"))
    return c.cast("string")


def one_hot(code: Column, k: int) -> Column:
    """FLOAT array of length ``k`` with 1 at ``code``."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == code).cast("float"))


def sparse_one_hot(code: Column, k: int) -> Column:
    """F9 without the zeros: (size, index) of the one entry that is 1, whatever the cardinality."""
    return F.struct(F.lit(int(k)).alias("size"), code.cast("int").alias("index"))


def dense_one_hot(sparse: Column) -> Column:
    """The FLOAT array that a sparse one-hot value stands for."""
    return F.transform(F.sequence(F.lit(0), sparse["size"] - 1), lambda i: (i == sparse["index"]).cast("float"))


def _kind_table(df: DataFrame, roles: Roles, low: int, high: int):
    """Exact distinct counts where they decide a kind; one approximate pass plus
    one bounded exact pass (``collect_set`` only for columns near a threshold)."""
    fields = [f for f in df.schema.fields if f.name not in roles.excluded()]
    vals = {f.name: (_clean_num(F.col(f"`{f.name}`"), f.dataType) if _is_numeric(f.dataType) else canonical_string(F.col(f"`{f.name}`"), f.dataType)) for f in fields}
    approx = df.agg(*[F.approx_count_distinct(vals[f.name], 0.01).alias(f"a{i}") for i, f in enumerate(fields)]).first()
    exact_needed = []
    for i, f in enumerate(fields):
        a = approx[f"a{i}"]
        thr = low if _is_numeric(f.dataType) else high
        if a <= 4 * thr + 8:
            exact_needed.append(i)
    exact = {}
    if exact_needed:
        row = df.agg(*[F.size(F.collect_set(vals[fields[i].name])).alias(f"e{i}") for i in exact_needed]).first()
        exact = {i: row[f"e{i}"] for i in exact_needed}
    out = []
    for i, f in enumerate(fields):
        n = exact.get(i, approx[f"a{i}"])
        numeric_type = _is_numeric(f.dataType)
        if n == 0:
            kind = DROPPED
        elif numeric_type and n > low:
            kind = NUMERIC
        else:
            kind = CATEGORICAL
        high_card = (not numeric_type) and n > high
        out.append((f.name, kind, n, high_card, f.dataType))
    return out


def infer_kinds(df: DataFrame, roles: Roles, low_cardinality: int = DEFAULT_LOW_CARDINALITY, max_categorical_cardinality: int = DEFAULT_MAX_CATEGORICAL_CARDINALITY) -> DataFrame:
    """F1 + F2: (feature, kind, position, high_cardinality) in input column order.

    Numeric (bool included) with at most ``low_cardinality`` distinct values ->
    categorical; more -> numeric; other types -> categorical. A column with no
    value at all is reported as ``dropped``. High cardinality (string columns
    over ``max_categorical_cardinality``) is reported, the column is kept.
    """
    kinds = _kind_table(df, roles, low_cardinality, max_categorical_cardinality)
    rows, pos = [], {NUMERIC: 0, CATEGORICAL: 0, DROPPED: 0}
    for name, kind, _, hc, _ in kinds:
        rows.append((name, kind, pos[kind], hc))
        pos[kind] += 1
        if hc:
            log.warning("column %s has more than %d distinct values; kept as categorical", name, max_categorical_cardinality)
    return df.sparkSession.createDataFrame(rows, "feature string, kind string, position int, high_cardinality boolean")


@dataclass
class Preparer:
    """Estimator: ``fit(train) -> PreparedFeatures``."""

    roles: Roles
    low_cardinality: int = DEFAULT_LOW_CARDINALITY
    max_categorical_cardinality: int = DEFAULT_MAX_CATEGORICAL_CARDINALITY
    numeric_strategy: str = "median"  # median | mean | constant
    categorical_strategy: str = "most_frequent"  # most_frequent | constant
    numeric_fill: float = DEFAULT_NUMERIC_FILL
    categorical_fill: str = DEFAULT_CATEGORICAL_FILL

    def transform_for_classifier(self, df):  # F16: use before fit
        raise RuntimeError("Preparer is not fitted; call fit(train) first")

    transform_for_gan = transform_for_classifier

    def fit(self, df: DataFrame) -> "PreparedFeatures":
        if self.numeric_strategy not in ("median", "mean", "constant"):
            raise ValueError(f"unknown numeric strategy {self.numeric_strategy}")
        if self.categorical_strategy not in ("most_frequent", "constant"):
            raise ValueError(f"unknown categorical strategy {self.categorical_strategy}")
        spark = df.sparkSession
        kinds = _kind_table(df, self.roles, self.low_cardinality, self.max_categorical_cardinality)
        dropped = [k[0] for k in kinds if k[1] == DROPPED]
        if dropped:
            log.warning("dropping all-null columns %s", dropped)
        numeric = [k[0] for k in kinds if k[1] == NUMERIC]
        categorical = [k[0] for k in kinds if k[1] == CATEGORICAL]
        types = {k[0]: k[4] for k in kinds}

        # numeric fill values
        if not numeric:
            fills = {}
        elif self.numeric_strategy == "median":
            fills = exact_quantiles(df, numeric, 0.5)
        elif self.numeric_strategy == "mean":
            r = df.agg(*[F.avg(_clean_num(F.col(f"`{c}`"), types[c]).cast("double")).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
            fills = {c: r[f"m{i}"] for i, c in enumerate(numeric)}
        else:
            fills = {c: float(self.numeric_fill) for c in numeric}
        # scaler on imputed values (population std; zero -> 1), plus null presence of categoricals
        imp = {c: F.coalesce(_clean_num(F.col(f"`{c}`"), types[c]).cast("double"), F.lit(float(fills[c]))) for c in numeric}
        r = df.agg(
            *[F.avg(imp[c]).alias(f"mu{i}") for i, c in enumerate(numeric)],
            *[F.stddev_pop(imp[c]).alias(f"sd{i}") for i, c in enumerate(numeric)],
            *[F.count_if(canonical_string(F.col(f"`{c}`"), types[c]).isNull()).alias(f"nn{i}") for i, c in enumerate(categorical)],
            F.count(F.lit(1)).alias("__n"),
        ).first()
        means = {c: r[f"mu{i}"] for i, c in enumerate(numeric)}
        stds = {c: (r[f"sd{i}"] if r[f"sd{i}"] else 1.0) for i, c in enumerate(numeric)}
        has_null = {c: r[f"nn{i}"] > 0 for i, c in enumerate(categorical)}

        # categorical: value counts -> mode (smallest on ties) and sorted dictionary
        modes: dict[str, str] = {}
        categories = spark.createDataFrame([], "feature string, value string, code int")
        cards: dict[str, int] = {}
        small_dicts: dict[str, dict[str, int]] | None = {}
        if categorical:
            long = df.select(
                F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), canonical_string(F.col(f"`{c}`"), types[c]).alias("value")) for c in categorical])).alias("r")
            ).select("r.feature", "r.value").where(F.col("value").isNotNull())
            vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
            if self.categorical_strategy == "most_frequent":
                mrows = vc.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode")).collect()
                modes = {m["feature"]: m["mode"] for m in mrows}
            else:
                modes = {c: self.categorical_fill for c in categorical}
            extra = [(c, UNKNOWN) for c in categorical]
            if self.categorical_strategy == "constant":
                extra += [(c, self.categorical_fill) for c in categorical if has_null[c]]
            values = vc.select("feature", "value").unionByName(spark.createDataFrame(extra, "feature string, value string")).distinct()
            # codes: string order per column, by range-partitioned running counts
            numbered = global_row_number(values, "value", partition_by=["feature"], out="code")
            categories = staged(numbered.select("feature", "value", (F.col("code") - 1).cast("int").alias("code")), "categories")
            sizes, small_dicts = _dictionary_sizes(categories)
            cards = {f: n for f, (n, _) in sizes.items()}
        return PreparedFeatures(
            spark=spark,
            params=dict(
                roles=dict(target=self.roles.target, id=self.roles.id, time=self.roles.time, drop=list(self.roles.drop)),
                numeric_strategy=self.numeric_strategy,
                categorical_strategy=self.categorical_strategy,
                numeric_fill=self.numeric_fill,
                categorical_fill=self.categorical_fill,
            ),
            numeric=numeric,
            categorical=categorical,
            dropped=dropped,
            types={c: types[c].simpleString() for c in numeric + categorical},
            fills=fills,
            means=means,
            stds=stds,
            modes=modes,
            cardinality=cards,
            categories=categories,
            small_dicts=small_dicts,
            dictionary_bytes={f: b for f, (_, b) in sizes.items()} if categorical else {},
        )


def _dictionary_sizes(categories: DataFrame) -> tuple[dict[str, tuple[int, int]], dict[str, dict[str, int]]]:
    """(rows, bytes) of each column's dictionary, and the entries of those small enough to be literals."""
    rows = categories.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 16).alias("b")).collect()
    sizes = {r["feature"]: (r["n"], r["b"]) for r in rows}
    small = [f for f, (n, _) in sizes.items() if n <= MAP_LIMIT]
    dicts: dict[str, dict[str, int]] = {f: {} for f in small}
    for x in categories.where(F.col("feature").isin(small)).collect() if small else []:  # MAP_LIMIT rows a column at most
        dicts[x["feature"]][x["value"]] = x["code"]
    return sizes, dicts


@dataclass
class PreparedFeatures:
    spark: SparkSession
    params: dict
    numeric: list[str]
    categorical: list[str]
    dropped: list[str]
    types: dict[str, str]
    fills: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]
    modes: dict[str, str]
    cardinality: dict[str, int]
    categories: DataFrame
    small_dicts: dict[str, dict[str, int]] = field(default_factory=dict)
    dictionary_bytes: dict[str, int] = field(default_factory=dict)

    # -------------------------------------------------------------- tables
    @property
    def target(self) -> str:
        return self.params["roles"]["target"]

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical

    def spec(self) -> DataFrame:
        """(feature, kind, position, cardinality)."""
        rows = [(c, NUMERIC, i, None) for i, c in enumerate(self.numeric)]
        rows += [(c, CATEGORICAL, i, int(self.cardinality[c])) for i, c in enumerate(self.categorical)]
        return self.spark.createDataFrame(rows, "feature string, kind string, position int, cardinality int")

    def numeric_stats(self) -> DataFrame:
        rows = [(c, float(self.fills[c]), float(self.means[c]), float(self.stds[c])) for c in self.numeric]
        return self.spark.createDataFrame(rows, "feature string, fill double, mean double, std double")

    def categorical_fills(self) -> DataFrame:
        return self.spark.createDataFrame([(c, self.modes[c]) for c in self.categorical], "feature string, fill string")

    @property
    def numeric_dim(self) -> int:
        return len(self.numeric)

    @property
    def categorical_dims(self) -> list[int]:
        return [int(self.cardinality[c]) for c in self.categorical]

    # -------------------------------------------------------------- pieces
    def _num(self, df: DataFrame, c: str) -> Column:
        dt = df.schema[c].dataType
        return F.coalesce(_clean_num(F.col(f"`{c}`"), dt).cast("double"), F.lit(float(self.fills[c])))

    def _cat_value(self, df: DataFrame, c: str) -> Column:
        dt = df.schema[c].dataType
        return F.coalesce(canonical_string(F.col(f"`{c}`"), dt), F.lit(self.modes[c]))

    def _unknown_code(self, c: str) -> int:
        if c in self.small_dicts:
            return self.small_dicts[c][UNKNOWN]
        return self.categories.where((F.col("feature") == c) & (F.col("value") == UNKNOWN)).first()["code"]

    def _encode(self, df: DataFrame, keep_extra=()) -> DataFrame:
        """Adds ``__code_<c>`` for every categorical column (F8)."""
        out = df
        for c in self.categorical:
            v = self._cat_value(out, c)
            unk = self._unknown_code(c)
            if c in self.small_dicts:
                d = self.small_dicts[c]
                m = F.create_map(*[x for k, code in sorted(d.items()) for x in (F.lit(k), F.lit(code))])
                out = out.withColumn(f"__code_{c}", F.coalesce(F.try_element_at(m, v), F.lit(unk)).cast("int"))
            else:
                dic = self.categories.where(F.col("feature") == c).select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__code_{c}"))
                if self.dictionary_bytes.get(c, BROADCAST_BYTES + 1) <= BROADCAST_BYTES:
                    dic = F.broadcast(dic)
                out = out.withColumn(f"__v_{c}", v).join(dic, f"__v_{c}", "left").drop(f"__v_{c}")
                out = out.withColumn(f"__code_{c}", F.coalesce(F.col(f"__code_{c}"), F.lit(unk)))
        return out

    # -------------------------------------------------------------- views
    def transform_for_classifier(self, df: DataFrame, passthrough=()) -> DataFrame:
        """imputed raw numeric columns + categorical codes; the target is
        passed through when present, plus any ``passthrough`` columns (e.g. the id)."""
        enc = self._encode(df)
        keep = [c for c in passthrough if c in df.columns]
        tgt = [self.target] if self.target in df.columns and self.target not in keep else []
        return enc.select(
            *[F.col(f"`{c}`") for c in keep],
            *[self._num(df, c).alias(c) for c in self.numeric],
            *[F.col(f"__code_{c}").alias(c) for c in self.categorical],
            *[F.col(f"`{c}`") for c in tgt],
        )

    def transform_for_gan(self, df: DataFrame, passthrough=(), sparse: bool = False) -> DataFrame:
        """``numeric`` ARRAY<FLOAT> of standardised values (empty if no
        numeric column) and ``onehot_<c>`` ARRAY<FLOAT> per categorical column,
        or with ``sparse`` a (size, index) struct: one entry a row, however many categories."""
        enc = self._encode(df)
        keep = [c for c in passthrough if c in df.columns]
        tgt = [self.target] if self.target in df.columns and self.target not in keep else []
        num = F.array(*[((self._num(df, c) - F.lit(float(self.means[c]))) / F.lit(float(self.stds[c]))).cast("float") for c in self.numeric]) if self.numeric else F.array().cast("array<float>")
        encode = sparse_one_hot if sparse else one_hot
        ohs = [encode(F.col(f"__code_{c}"), int(self.cardinality[c])).alias(f"onehot_{c}") for c in self.categorical]
        return enc.select(*[F.col(f"`{c}`") for c in keep], num.alias("numeric"), *ohs, *[F.col(f"`{c}`") for c in tgt])

    def decode_codes(self, df: DataFrame, code_cols: dict[str, str]) -> DataFrame:
        """code column -> category string for each categorical column (F10 back half)."""
        out = df
        for c, code_col in code_cols.items():
            if c in self.small_dicts:
                inv = {code: k for k, code in self.small_dicts[c].items()}
                m = F.create_map(*[x for code, k in sorted(inv.items()) for x in (F.lit(code), F.lit(k))])
                out = out.withColumn(c, F.try_element_at(m, F.col(code_col)))
            else:
                dic = self.categories.where(F.col("feature") == c).select(F.col("code").alias(code_col), F.col("value").alias(c))
                if self.dictionary_bytes.get(c, BROADCAST_BYTES + 1) <= BROADCAST_BYTES:
                    dic = F.broadcast(dic)
                out = out.join(dic, code_col, "left")
        return out

    def inverse_transform_gan(self, df: DataFrame, passthrough=()) -> DataFrame:
        """F13 = F5 (z * std + mean) + F10 (arg-max -> category) on the arrays or the sparse structs of F12."""

        def code(c: str) -> Column:
            v = F.col(f"onehot_{c}")
            if isinstance(df.schema[f"onehot_{c}"].dataType, T.StructType):
                return v["index"]
            return (F.array_position(v, F.array_max(v)) - 1).cast("int")

        keep = [c for c in passthrough if c in df.columns]
        base = df.select(
            *[F.col(f"`{c}`") for c in keep],
            *[(F.col("numeric")[i].cast("double") * F.lit(float(self.stds[c])) + F.lit(float(self.means[c]))).alias(c) for i, c in enumerate(self.numeric)],
            *[code(c).alias(f"__code_{c}") for c in self.categorical],
        )
        dec = self.decode_codes(base, {c: f"__code_{c}" for c in self.categorical})
        return dec.select(*[F.col(f"`{c}`") for c in keep], *self.numeric, *self.categorical)

    def observation_vector(self, classifier_view: DataFrame, out: str = "obs", passthrough=()) -> DataFrame:
        """all feature columns in order (codes for categoricals) as ARRAY<FLOAT>."""
        keep = [c for c in passthrough if c in classifier_view.columns]
        return classifier_view.select(*keep, F.array(*[F.col(f"`{c}`").cast("float") for c in self.features]).alias(out))

    # -------------------------------------------------------------- S7
    def save(self, path: str) -> str:
        p = path.rstrip("/")
        meta = dict(self.params, numeric=self.numeric, categorical=self.categorical, dropped=self.dropped, types=self.types, modes=self.modes, cardinality=self.cardinality)
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(p + "/params")
        self.spec().coalesce(1).write.mode("overwrite").parquet(p + "/spec")
        self.numeric_stats().coalesce(1).write.mode("overwrite").parquet(p + "/numeric_stats")
        self.categories.write.mode("overwrite").parquet(p + "/categories")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PreparedFeatures":
        p = path.rstrip("/")
        meta = json.loads(spark.read.parquet(p + "/params").first()["meta"])
        ns = {r["feature"]: r for r in spark.read.parquet(p + "/numeric_stats").collect()}
        cats = spark.read.parquet(p + "/categories")
        cards = {k: int(v) for k, v in meta["cardinality"].items()}
        sizes, small = _dictionary_sizes(cats)
        params = {k: meta[k] for k in ("roles", "numeric_strategy", "categorical_strategy", "numeric_fill", "categorical_fill")}
        return PreparedFeatures(
            spark=spark,
            params=params,
            numeric=meta["numeric"],
            categorical=meta["categorical"],
            dropped=meta["dropped"],
            types=meta["types"],
            fills={c: ns[c]["fill"] for c in meta["numeric"]},
            means={c: ns[c]["mean"] for c in meta["numeric"]},
            stds={c: ns[c]["std"] for c in meta["numeric"]},
            modes=meta["modes"],
            cardinality=cards,
            categories=cats,
            small_dicts=small,
            dictionary_bytes={f: b for f, (_, b) in sizes.items()},
        )
