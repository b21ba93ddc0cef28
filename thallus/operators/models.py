"""Linear and mixed models from sufficient statistics.

One distributed aggregation reduces the rows to moments per combination of factor
levels; what remains per ``by`` group is a k x k system, solved on the executors.
Terms are names or ``a:b`` interactions; text columns are factors with treatment
contrasts in level order, numeric columns are covariates.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tails import chi2_tail, f_tail, t_tail
from .relational import attach

ALIASED = 1e-10


# -- moments -----------------------------------------------------------------------

def variables(df: DataFrame, terms: Sequence[str]) -> tuple[list[str], list[str]]:
    """Factor and covariate columns that the terms use."""
    names = list(dict.fromkeys(v for t in terms for v in t.split(":")))
    kinds = dict(df.dtypes)
    factors = [v for v in names if kinds[v] in ("string", "boolean")]
    return factors, [v for v in names if v not in factors]


def complete_cases(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Rows that have all ``cols``; a value outside its factor's ``levels`` counts as missing."""
    present = [F.col(c).isNotNull() for c in cols]
    listed = [F.col(c).isin(list(levels[c])) for c in cols if c in levels] if levels else []
    return df.where(reduce(Column.__and__, [*present, *listed]))


def products(terms: Sequence[str], covariates: Sequence[str]) -> list[str]:
    """The numeric part of each term (``a:b`` is the product of two covariates), each once."""
    parts = (":".join(v for v in t.split(":") if v in covariates) for t in terms)
    return list(dict.fromkeys(p for p in parts if p))


def product_column(part: str) -> Column:
    return reduce(Column.__mul__, [F.col(v).cast("double") for v in part.split(":")])


def cell_moments(
    df: DataFrame, y: str, factors: Sequence[str], covariates: Sequence[str], by: Sequence[str],
    terms: Sequence[str] | None = None, levels: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Count, means and centred cross products of y and the numeric parts of ``terms`` (the covariates by default) per cell.

    Spark's central-moment aggregates merge without cancellation and combine map-side.
    """
    used = complete_cases(df, [y, *factors, *covariates], levels)
    numbers = [F.col(y).cast("double"), *map(product_column, products(terms if terms is not None else covariates, covariates))]
    means = [F.avg(v).alias(f"m{i}") for i, v in enumerate(numbers)]
    crossed = [
        (F.covar_pop(numbers[i], numbers[j]) * F.count(F.lit(1))).alias(f"c{i}_{j}")
        for i, j in combinations_with_replacement(range(len(numbers)), 2)
    ]
    return used.groupBy(*by, *factors).agg(F.count(F.lit(1)).cast("double").alias("n"), *means, *crossed)


class _Columns:
    """Model columns of one group: per cell a factor part, times at most one numeric part."""

    def __init__(self, cells: pd.DataFrame, factors, covariates, terms, levels, centre: bool):
        n = cells["n"].to_numpy(float)
        self.n, self.terms = n, list(terms)
        numeric = products(self.terms, covariates)
        self.means = [cells[f"m{i}"].to_numpy(float) for i in range(len(numeric) + 1)]
        self.shift = [float(np.average(m, weights=n)) if centre or i == 0 else 0.0 for i, m in enumerate(self.means)]
        self.means = [m - s for m, s in zip(self.means, self.shift)]
        self.within = {}
        for i, j in combinations_with_replacement(range(len(self.means)), 2):
            self.within[i, j] = self.within[j, i] = cells[f"c{i}_{j}"].to_numpy(float)
        ones = np.ones(len(cells))
        self.names, self.owner, self.parts = ["(Intercept)"], [-1], [(ones, None)]
        for t, term in enumerate(self.terms):
            part = ":".join(v for v in term.split(":") if v in covariates)
            built = [("", ones, numeric.index(part) + 1 if part else None)]
            for v in term.split(":"):
                if v in covariates:
                    built = [(f"{a}:{v}".lstrip(":"), d, z) for a, d, z in built]
                else:
                    seen = sorted(cells[v].unique(), key=str)
                    order = [lv for lv in levels.get(v, seen) if lv in set(seen)]
                    built = [
                        (f"{a}:{v}[{lv}]".lstrip(":"), d * (cells[v] == lv).to_numpy(float), z)
                        for a, d, z in built for lv in order[1:]
                    ]
            for name, d, z in built:
                self.names.append(name)
                self.owner.append(t)
                self.parts.append((d, z))
        self.parts.append((ones, 0))  # the response, last
        size = len(self.parts)
        self.gram = np.empty((size, size))
        for i in range(size):
            for j in range(i, size):
                self.gram[i, j] = self.gram[j, i] = self._product(self.parts[i], self.parts[j])

    def _product(self, left, right) -> float:
        (a, z), (b, w) = left, right
        mean_z = 1.0 if z is None else self.means[z]
        mean_w = 1.0 if w is None else self.means[w]
        inner = self.n * mean_z * mean_w
        if z is not None and w is not None:
            inner = inner + self.within[z, w]
        return float((a * b * inner).sum())

    def of_terms(self, keep) -> list[int]:
        return [i for i, t in enumerate(self.owner) if t < 0 or t in keep]

    def rss(self, columns: Sequence[int]) -> tuple[float, list[int]]:
        """Residual sum of squares and the columns that are not aliased, swept left to right."""
        a, y, kept = self.gram.copy(), len(self.parts) - 1, []
        for j in columns:
            if a[j, j] > ALIASED * self.gram[j, j] > 0:
                a = a - np.outer(a[:, j], a[j, :]) / a[j, j]
                kept.append(j)
        return max(a[y, y], 0.0), kept


def _head_schema(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in by)


def _ordered(by: Sequence[str], df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in by]


def _headed(pdf: pd.DataFrame, by: Sequence[str], rows: list[dict], names: Sequence[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=list(names))
    for position, column in enumerate(by):
        out.insert(position, column, [pdf[column].iloc[0]] * len(out))
    return out


def _by_group(cells: DataFrame, by: Sequence[str], solve, fields: str) -> DataFrame:
    by = _ordered(by, cells)
    names = [f.strip().split(" ")[0] for f in fields.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _headed(pdf, by, solve(pdf), names)

    return cells.groupBy(*by).applyInPandas(run, _head_schema(cells, by) + fields)


def lm(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str] = (), levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Least-squares coefficients: ``coefficient, estimate, std_error, t_value, p_value, df, sigma, r_squared, n``."""
    factors, covariates = variables(df, terms)
    levels = dict(levels or {})

    def solve(pdf: pd.DataFrame) -> list[dict]:
        model = _Columns(pdf, factors, covariates, terms, levels, centre=False)
        rss, kept = model.rss(model.of_terms(range(len(terms))))
        n = model.n.sum()
        dof = n - len(kept)
        y_at = len(model.parts) - 1
        inverse = np.linalg.inv(model.gram[np.ix_(kept, kept)])
        beta = inverse @ model.gram[kept, y_at]
        total = model.gram[y_at, y_at]
        rows = []
        for i, name in enumerate(model.names):
            row = dict(coefficient=name, estimate=None, std_error=None, t_value=None, p_value=None, df=dof,
                       sigma=math.sqrt(rss / dof) if dof > 0 else None, r_squared=1 - rss / total if total > 0 else None, n=n)
            if i in kept:
                at = kept.index(i)
                row["estimate"] = beta[at] + (model.shift[0] if i == 0 else 0.0)
                if dof > 0 and rss > 0:
                    row["std_error"] = math.sqrt(rss / dof * inverse[at, at])
                    row["t_value"] = row["estimate"] / row["std_error"]
                    row["p_value"] = t_tail(row["t_value"], dof)
            rows.append(row)
        return rows

    fields = ("coefficient string, estimate double, std_error double, t_value double, p_value double, "
              "df double, sigma double, r_squared double, n double")
    return _by_group(cell_moments(df, y, factors, covariates, by, terms, levels), by, solve, fields)


def anova(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str] = (), levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Type II table: ``term, sum_sq, df, f_value, p_value``, residuals last.

    A term is tested against all terms that do not contain it; the error is that of the
    full model.  Aliased columns drop out left to right.
    """
    factors, covariates = variables(df, terms)
    levels = dict(levels or {})
    parts = [frozenset(t.split(":")) for t in terms]

    def solve(pdf: pd.DataFrame) -> list[dict]:
        model = _Columns(pdf, factors, covariates, terms, levels, centre=True)
        full, kept = model.rss(model.of_terms(range(len(terms))))
        dof = model.n.sum() - len(kept)
        rows = []
        for t, term in enumerate(terms):
            others = {u for u in range(len(terms)) if u != t and not parts[t] < parts[u]}
            without, fewer = model.rss(model.of_terms(others))
            with_t, more = model.rss(model.of_terms(others | {t}))
            df_t = len(more) - len(fewer)
            ss = max(without - with_t, 0.0)
            f = (ss / df_t) / (full / dof) if df_t > 0 and dof > 0 and full > 0 else None
            rows.append(dict(term=term, sum_sq=ss, df=float(df_t), f_value=f, p_value=None if f is None else f_tail(f, df_t, dof)))
        rows.append(dict(term="Residuals", sum_sq=full, df=float(dof), f_value=None, p_value=None))
        return rows

    return _by_group(cell_moments(df, y, factors, covariates, by, terms, levels), by, solve, "term string, sum_sq double, df double, f_value double, p_value double")


def residuals(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str] = (), levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows used by the fit, with ``fitted`` and ``residual``.  Each cell gets a base value
    and one slope per numeric part; only those small rows are joined back."""
    factors, covariates = variables(df, terms)
    numeric = products(terms, covariates)
    cells = cell_moments(df, y, factors, covariates, by, terms, levels)
    fits = fitted_cells(cells, terms, factors, covariates, by, levels)
    used = complete_cases(df, [y, *factors, *covariates], levels)
    joined = attach(used, fits, [*_ordered(by, cells), *factors])
    fitted = F.col("_base")
    slopes = [f"_s{i}" for i in range(len(numeric))]
    for s, part in zip(slopes, numeric):
        fitted = fitted + F.col(s) * product_column(part)
    return joined.withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted")).drop("_base", *slopes)


def fitted_cells(cells: DataFrame, terms: Sequence[str], factors: Sequence[str], covariates: Sequence[str], by: Sequence[str] = (), levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Per cell of ``cell_moments`` its base value ``_base`` and one slope ``_s<i>`` per numeric part."""
    levels = dict(levels or {})
    keys = [*_ordered(by, cells), *factors]
    numeric = products(terms, covariates)
    slopes = [f"_s{i}" for i in range(len(numeric))]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        model = _Columns(pdf, factors, covariates, terms, levels, centre=False)
        _, kept = model.rss(model.of_terms(range(len(terms))))
        beta = np.linalg.solve(model.gram[np.ix_(kept, kept)], model.gram[kept, len(model.parts) - 1])
        out = pdf[keys].copy()
        columns = {None: np.full(len(pdf), model.shift[0]), **{i + 1: np.zeros(len(pdf)) for i in range(len(numeric))}}
        for b, j in zip(beta, kept):
            d, z = model.parts[j]
            columns[z] = columns[z] + b * d
        out["_base"] = columns[None]
        for i, s in enumerate(slopes):
            out[s] = columns[i + 1]
        return out

    schema = _head_schema(cells, keys) + ", ".join(f"{c} double" for c in ["_base", *slopes])
    schema_order = [c for c in cells.columns if c in keys]
    return cells.groupBy(*[k for k in keys if k in by]).applyInPandas(lambda pdf: solve(pdf)[[*schema_order, "_base", *slopes]], schema)


# -- random intercepts -------------------------------------------------------------

_RESPONSE = "9999||y"


def _marginal(terms: Sequence[str], covariates: Sequence[str]) -> list[str]:
    """Covariates that may be centred: every term that uses one is also there without it."""
    parts = {frozenset(t.split(":")) for t in terms} | {frozenset()}
    return [v for v in covariates if all(p - {v} in parts for p in parts if v in p)]


def _entries(terms: Sequence[str], factors: Sequence[str], lowest: Mapping[str, Column], levels: Mapping[str, Sequence], y: str) -> Column:
    """A row's non-zero design values, (column, value) in column order; the response comes last.

    A column is named by its term's number, the places of its levels where an order was given, and its
    own name, so that text order is column order and levels stay data.
    """
    made = [F.struct(F.lit("0000||(Intercept)").alias("c"), F.lit(1.0).alias("v"))]
    for t, term in enumerate(terms, start=1):
        places, names, value, there = [], [], F.lit(1.0), F.lit(True)
        for v in term.split(":"):
            if v in factors:
                if v in levels:
                    places.append(F.lpad(F.array_position(F.array(*[F.lit(lv) for lv in levels[v]]), F.col(v)).cast("string"), 6, "0"))
                names.append(F.concat(F.lit(f"{v}["), F.col(v).cast("string"), F.lit("]")))
                there = there & (F.col(v) != lowest[v])
            else:
                names.append(F.lit(v))
                value = value * F.col(f"_{v}")
        name = F.concat_ws("|", F.lit(f"{t:04d}"), F.concat_ws(".", *places) if places else F.lit(""), F.concat_ws(":", *names))
        made.append(F.when(there, F.struct(name.alias("c"), value.alias("v"))))
    made.append(F.struct(F.lit(_RESPONSE).alias("c"), (F.col(y).cast("double") - F.col("_middle")).alias("v")))
    return F.filter(F.array(*made), lambda e: e.isNotNull())


def _pairs(entries: Column) -> Column:
    """All products of two entries, the first not after the second."""
    return F.flatten(F.transform(entries, lambda a, i: F.transform(
        F.slice(entries, i + 1, F.size(entries)), lambda b: F.struct(a["c"].alias("c1"), b["c"].alias("c2"), (a["v"] * b["v"]).alias("x")))))


def _long_gram(df: DataFrame, y: str, terms: Sequence[str], subject: str, by: Sequence[str], factors: Sequence[str], covariates: Sequence[str], levels: Mapping[str, Sequence] | None) -> DataFrame:
    """What a random-intercept fit needs, as cells: ``by, kind, size, c1, c2, x``.

    ``p``: inner products of two columns; ``q``: products of two columns' sums over a subject, added
    up over the subjects of one size; ``n``: subjects of a size; ``m``: the middle of the response
    (c1 = y) and of each centred covariate.
    """
    given = dict(levels or {})
    used = complete_cases(df, [y, subject, *factors, *covariates], given)
    centred = _marginal(terms, covariates)
    middles = used.groupBy(*by).agg(
        F.avg(F.col(y).cast("double")).alias("_middle"), *[F.avg(F.col(v).cast("double")).alias(f"_m_{v}") for v in centred],
        *[F.min(f).alias(f"_low_{f}") for f in factors if f not in given],
    )
    lowest = {f: F.lit(given[f][0]) if f in given else F.col(f"_low_{f}") for f in factors}
    joined = attach(used, middles, by)
    joined = joined.withColumns({f"_{v}": F.col(v).cast("double") - (F.col(f"_m_{v}") if v in centred else F.lit(0.0)) for v in covariates})
    rows = joined.select(*by, F.col(subject).alias("_subject"), _entries(terms, factors, lowest, given, y).alias("_entries"))
    plain = rows.select(*by, F.explode(_pairs(F.col("_entries"))).alias("e")).groupBy(*by, "e.c1", "e.c2").agg(F.sum("e.x").alias("x"))
    sums = rows.select(*by, "_subject", F.explode("_entries").alias("e")).groupBy(*by, "_subject", F.col("e.c").alias("c")).agg(F.sum("e.v").alias("v"), F.count(F.lit(1)).alias("n"))
    # every row has one entry for the response, so that column's count is the subject's size
    subjects = sums.groupBy(*by, "_subject").agg(F.max(F.when(F.col("c") == _RESPONSE, F.col("n"))).alias("size"), F.sort_array(F.collect_list(F.struct("c", "v"))).alias("_entries"))
    subjects = subjects.select(*by, "size", "_entries")
    within = subjects.select(*by, "size", F.explode(_pairs(F.col("_entries"))).alias("e")).groupBy(*by, "size", "e.c1", "e.c2").agg(F.sum("e.x").alias("x"))
    sizes = subjects.groupBy(*by, "size").agg(F.count(F.lit(1)).cast("double").alias("x"))
    told = middles.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("c1"), F.col(m).alias("x")) for c, m in [("y", "_middle"), *[(v, f"_m_{v}") for v in centred]]])))
    none, blank = F.lit(None).cast("long"), F.lit("")

    def cells(table: DataFrame, kind: str, size: Column = none, c1: Column | str = blank, c2: Column | str = blank) -> DataFrame:
        one, two = (F.col(c) if isinstance(c, str) else c for c in (c1, c2))
        return table.select(*by, F.lit(kind).alias("kind"), size.alias("size"), one.alias("c1"), two.alias("c2"), "x")

    return (
        cells(plain, "p", c1="c1", c2="c2").unionByName(cells(within, "q", F.col("size"), "c1", "c2"))
        .unionByName(cells(sizes, "n", F.col("size"))).unionByName(cells(told, "m", c1="c1"))
    )


class _RandomIntercept:
    """REML fit of one group from its cells."""

    def __init__(self, cells: pd.DataFrame):
        kind = cells["kind"].to_numpy()
        p, q, counts, middles = (cells[kind == k] for k in "pqnm")
        self.keys = sorted(set(p["c1"]))  # the response sorts last
        place = {c: i for i, c in enumerate(self.keys)}
        self.k = len(self.keys) - 1
        self.names = [c.split("|", 2)[2] for c in self.keys[:-1]]
        self.owner = [int(c[:4]) - 1 for c in self.keys[:-1]]
        self.middles = dict(zip(middles["c1"], middles["x"].astype(float)))
        counts = counts.sort_values("size")
        self.size, self.subjects = counts["size"].to_numpy(float), counts["x"].to_numpy(float)
        self.plain = self._square(p, place)
        at = {s: i for i, s in enumerate(counts["size"])}
        which = q["size"].map(at).to_numpy()
        # sparse: a size of subjects touches few pairs of columns
        self.q = (which, q["c1"].map(place).to_numpy(), q["c2"].map(place).to_numpy(), q["x"].to_numpy(float))
        n = float((self.size * self.subjects).sum())
        self.kept, a = [], self.plain.copy()
        for j in range(self.k):
            if a[j, j] > ALIASED * self.plain[j, j] > 0:
                a = a - np.outer(a[:, j], a[j, :]) / a[j, j]
                self.kept.append(j)
        self.dof = n - len(self.kept)
        self.fit = self._best() if self.dof > 0 else None

    def _square(self, cells: pd.DataFrame, place: Mapping[str, int]) -> np.ndarray:
        out = np.zeros((len(place), len(place)))
        i, j = cells["c1"].map(place).to_numpy(), cells["c2"].map(place).to_numpy()
        out[i, j] = out[j, i] = cells["x"].to_numpy(float)
        return out

    def at(self, theta: float):
        which, i, j, x = self.q
        weight = theta / (1 + self.size * theta)
        taken = np.zeros_like(self.plain)
        np.add.at(taken, (i, j), weight[which] * x)
        whole = self.plain - taken - np.triu(taken, 1).T - np.tril(taken, -1).T
        xx, xy = whole[np.ix_(self.kept, self.kept)], whole[self.kept, self.k]
        beta = np.linalg.solve(xx, xy)
        rest = max(whole[self.k, self.k] - beta @ xy, 1e-300)
        deviance = (self.subjects * np.log1p(self.size * theta)).sum() + np.linalg.slogdet(xx)[1] + self.dof * math.log(rest)
        return deviance, beta, xx, rest

    def _best(self):
        def value(ratio: float) -> float:  # ratio of between to total variance
            return self.at(ratio / (1 - ratio))[0]

        grid = np.linspace(0.0, 0.9999, 60)
        seen = [value(r) for r in grid]
        best = int(np.argmin(seen))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
        golden = (math.sqrt(5) - 1) / 2
        while high - low > 1e-12:
            left, right = high - golden * (high - low), low + golden * (high - low)
            if value(left) <= value(right):
                high = right
            else:
                low = left
        theta = (low + high) / 2 / (1 - (low + high) / 2)
        if seen[0] <= self.at(theta)[0]:
            theta = 0.0
        return theta, *self.at(theta)

    def uncentred(self) -> np.ndarray:
        """Rows: the coefficients of the given covariates, as combinations of those of the centred ones."""
        out = np.eye(len(self.kept))
        name_at = {self.names[j]: a for a, j in enumerate(self.kept)}
        for a, j in enumerate(self.kept):
            parts = [] if self.names[j] == "(Intercept)" else self.names[j].split(":")
            shifted = [v for v in parts if v in self.middles]
            for chosen in range(1, 1 << len(shifted)):
                gone = [v for b, v in enumerate(shifted) if chosen >> b & 1]
                left = ":".join(p for p in parts if p not in gone) or "(Intercept)"
                if left in name_at:
                    out[name_at[left], a] += (-1) ** len(gone) * math.prod(self.middles[v] for v in gone)
        return out


def lmm(
    df: DataFrame, y: str, terms: Sequence[str], subject: str, by: Sequence[str] = (), table: str = "fixed",
    levels: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Random-intercept model by REML.

    ``table='fixed'``: coefficients, variances and fit; ``table='wald'``: Type II Wald
    chi-square per term.  Factor levels are data: rows become their non-zero (column, value)
    entries, and one grouped sum each gives the inner products of all columns and those of the
    subjects' sums, pooled by subject size: with s, t the sums of a subject of n rows,
    ``V⁻¹ = I - θ/(1+nθ) 11'`` needs no more.  The response and the covariates are centred per ``by``
    group first, so that a large mean cancels nothing (a covariate that some term uses without its
    lower terms stays as it is); coefficients are those of the given columns again.  The first level,
    in the given order or else the lowest of a group, is the reference.
    """
    factors, covariates = variables(df, terms)
    cells = _long_gram(df, y, terms, subject, by, factors, covariates, levels)

    def fixed(pdf: pd.DataFrame) -> list[dict]:
        model = _RandomIntercept(pdf)
        if model.fit is None:
            return []
        theta, deviance, beta, xx, rest = model.fit
        error, back = rest / model.dof, model.uncentred()
        se = np.sqrt(np.diag(back @ np.linalg.inv(xx) @ back.T) * error)
        beta = back @ beta + np.array([model.middles["y"] if j == 0 else 0.0 for j in model.kept])
        reml = deviance + model.dof * (1 + math.log(2 * math.pi / model.dof))
        return [
            dict(coefficient=model.names[j], estimate=beta[i], std_error=se[i], t_value=beta[i] / se[i], var_subject=theta * error,
                 var_residual=error, reml_deviance=reml, subjects=float(model.subjects.sum()))
            for i, j in enumerate(model.kept)
        ]

    parts = [frozenset(t.split(":")) for t in terms]

    def wald(pdf: pd.DataFrame) -> list[dict]:
        model = _RandomIntercept(pdf)
        if model.fit is None:
            return []
        _, _, beta, xx, rest = model.fit
        cov = np.linalg.inv(xx) * rest / model.dof

        def statistic(chosen) -> tuple[float, int]:
            at = [i for i, j in enumerate(model.kept) if model.owner[j] in chosen]
            return (float(beta[at] @ np.linalg.solve(cov[np.ix_(at, at)], beta[at])), len(at)) if at else (0.0, 0)

        rows = []
        for t, term in enumerate(terms):
            higher = {u for u in range(len(terms)) if parts[t] < parts[u]}
            (all_w, all_n), (high_w, high_n) = statistic(higher | {t}), statistic(higher)
            chisq, df_t = max(all_w - high_w, 0.0), all_n - high_n
            rows.append(dict(term=term, chisq=chisq, df=float(df_t), p_value=chi2_tail(chisq, df_t) if df_t else None))
        return rows

    if table == "wald":
        return _by_group(cells, by, wald, "term string, chisq double, df double, p_value double")
    return _by_group(
        cells, by, fixed,
        "coefficient string, estimate double, std_error double, t_value double, var_subject double, "
        "var_residual double, reml_deviance double, subjects double",
    )
