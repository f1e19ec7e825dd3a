"""§2.11 scalar functions as Column expressions.

Fixed values that must equal the original workbench's are listed together
under "Fixed values" comments, in their natural order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayflow.operators.metrics import checked


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------ text -> number

def first_number(text) -> Column:
    """First whitespace-separated token that parses as a number once '<', '>', '=' are removed; else null."""
    toks = F.split(_c(text), r"\s")
    nums = F.filter(F.transform(toks, lambda t: _try_double(F.translate(t, "<>=", ""))), lambda x: x.isNotNull())
    return F.get(nums, 0)


def _try_double(c: Column) -> Column:
    return F.when(F.length(c) > 0, c.try_cast("double"))


def category_number(text) -> Column:
    """All-digit text -> number, 'true'/'false' -> 1/0, else null (trimmed, case-insensitive)."""
    t = F.lower(F.trim(_c(text)))
    return (
        F.when(t.rlike(r"^\d+$"), t.try_cast("double"))
        .when(t == "false", F.lit(0.0))
        .when(t == "true", F.lit(1.0))
    )


def numeric_text(text) -> Column:
    """Text readouts that parse as numbers become numbers; others null (keep the text alongside)."""
    return _try_double(F.trim(_c(text)))


# Activity transform names
TRANSFORMS = ("uM_to_pIc50", "nM_to_pIc50", "log10", "none")


def activity_transform(value, name: str | None) -> Column:
    """uM_to_pIc50 = -log10(x*1e-6), nM_to_pIc50 = -log10(x*1e-9), log10; none/empty = identity; NaN/inf -> null."""
    v = _c(value)
    if name in (None, "", "none"):
        return v
    if name == "uM_to_pIc50":
        out = -F.log10(v * F.lit(1e-6))
    elif name == "nM_to_pIc50":
        out = -F.log10(v * F.lit(1e-9))
    elif name == "log10":
        out = F.log10(v)
    else:
        raise ValueError(f"Illegal transform value for {name}")
    return F.when(out.isNull() | F.isnan(out) | (F.abs(out) == F.lit(float("inf"))), F.lit(None)).otherwise(out)


def field_value(text, category: str, transform: str | None = None) -> Column:
    """Recipe dispatch: continuous -> first number, categorical -> category number; then transform. Empty -> null."""
    t = _c(text)
    if category == "continuous":
        v = first_number(t)
    elif category == "categorical":
        v = category_number(t)
    else:
        raise ValueError(f"Unknown category {category}")
    return F.when(F.length(F.trim(t)) == 0, F.lit(None).cast("double")).otherwise(activity_transform(v, transform))


# Censoring modifiers
MODIFIERS = ("<", ">", "=", "<=", ">=")


def modifier(text) -> Column:
    """Validated modifier; any other text fails the job."""
    t = _c(text)
    return checked(t, t.isin(*MODIFIERS), "Unknown modifier")


def is_greater(mod) -> Column:
    return _c(mod).isin(">", ">=")


def is_less(mod) -> Column:
    return _c(mod).isin("<", "<=")


# ------------------------------------------------------------ tokenizer

# Unit tokens kept in lower case by the tokenizer
UNIT_TOKENS = ("uM", "mM", "nM", "pM", "Kd", "Ki")


def tokenize(text) -> Column:
    """Label tokenizer: split on non-word characters (keeping '.'), lower-case unit and all-caps tokens,
    split camel case, lower-case, split at dots unless the token is a number, drop '.', append '/' if present."""
    t = _c(text)
    toks = F.filter(F.split(t, r"[^\w.]+"), lambda s: s != "")
    toks = F.transform(
        toks, lambda s: F.when(s.isin(*UNIT_TOKENS) | s.rlike(r"^[\p{Lu}\p{Nd}]+$"), F.lower(s)).otherwise(s)
    )
    camel = F.flatten(F.transform(toks, lambda s: F.split(s, r"(?<!^)(?=\p{Lu}\p{Ll})")))
    low = F.transform(camel, lambda s: F.lower(s))
    dotted = F.flatten(
        F.transform(low, lambda s: F.when(s.rlike(NUMBER_RE), F.array(s)).otherwise(_split_dots(s)))
    )
    kept = F.filter(dotted, lambda s: s != ".")
    return F.when(t.contains("/"), F.concat(kept, F.array(F.lit("/")))).otherwise(kept)


# a token that is a number (digits with one optional dot, optional exponent, optional type suffix, or hex)
NUMBER_RE = r"^(([0-9]+\.?[0-9]*|\.[0-9]+)(e[0-9]+)?[df]?|[0-9]+l|0x[0-9a-f]+l?)$"


def _split_dots(s: Column) -> Column:
    """String.split('\\.') semantics: trailing empty strings dropped."""
    trimmed = F.regexp_replace(s, r"\.+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\."))


# ------------------------------------------------------ readout name rules

# Concentration-unit patterns and their log10 exponents
UNIT_RULES = (
    ("Picomolar", -12.0, ("pM", "(?i)pico *molar")),
    ("Nanomolar", -9.0, ("nM", "(?i)nano *molar")),
    ("Micromolar", -6.0, ("uM", "(?i)micro *molar", "um")),
    ("Millimolar", -3.0, ("mM", "(?i)milli *molar")),
)


def unit_name(text) -> Column:
    t = _c(text)
    out = None
    for name, _, pats in UNIT_RULES:
        cond = t.rlike("|".join(f"(?:{p})" for p in pats))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def unit_exponent(text) -> Column:
    t = _c(text)
    out = None
    for _, exp, pats in UNIT_RULES:
        cond = t.rlike("|".join(f"(?:{p})" for p in pats))
        out = F.when(cond, F.lit(exp)) if out is None else out.when(cond, F.lit(exp))
    return out


# Splitting-readout patterns
READOUT_KINDS = (
    ("Assay", "(?i)assay description"),
    ("Measurement", "(?i)activity type"),
    ("Target", "(?i)^target"),
    ("Units", "(?i)unit"),
)
# Primary (classification) readout patterns on name or unit
PRIMARY_NAME = "(?i)inhibition"
PRIMARY_UNIT = ("%", "(?i)percent")


def readout_kind(name) -> Column:
    """Splitting-readout kinds of a readout name, in the fixed order Assay, Measurement, Target, Units."""
    n = _c(name)
    return F.filter(F.array(*[F.when(n.rlike(p), F.lit(k)) for k, p in READOUT_KINDS]), lambda x: x.isNotNull())


def is_primary_readout(name, unit=None) -> Column:
    n = _c(name)
    cond = n.rlike(PRIMARY_NAME)
    if unit is not None:
        u = _c(unit)
        cond = cond | F.coalesce(u.contains(PRIMARY_UNIT[0]) | u.rlike(PRIMARY_UNIT[1]), F.lit(False))
    return cond


# Keywords of readouts worth modelling
LEARNING_KEYWORDS = (
    "ec50", "ic50", "um", "%", "intrinsic clearance", "protein binding", "solubility",
    "activity", "results", "inhibition", "value",
)


def keyword_flag(name) -> Column:
    n = _c(name)
    cond = F.lit(False)
    for k in LEARNING_KEYWORDS:
        cond = cond | n.contains(k)
    return cond


# ------------------------------------------------------------ strings

def table_md5(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[_c(p) for p in parts]))


def name_string(m) -> Column:
    """'name:value' pairs (sorted by name) joined by '|'; 'NA' when empty or null."""
    entries = F.array_sort(F.map_entries(_c(m)))
    s = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|")
    return F.when(F.coalesce(F.size(_c(m)), F.lit(0)) <= 0, F.lit("NA")).otherwise(s)


def strip_type(name: str) -> str:
    """Remove a trailing ' [Type]' from a column title (metadata only)."""
    import re

    return re.sub(r"\s*\[[^\]]*\]$", "", name)


# ------------------------------------------------------------ numeric

# Abramowitz & Stegun 7.1.26 coefficients (|error| <= 1.5e-7)
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x) -> Column:
    """erf(x) by the A&S 7.1.26 polynomial (Spark SQL has no erf); absolute error <= 1.5e-7."""
    z = F.abs(_c(x))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    a1, a2, a3, a4, a5 = ERF_A
    poly = ((((F.lit(a5) * t + F.lit(a4)) * t + F.lit(a3)) * t + F.lit(a2)) * t + F.lit(a1)) * t
    y = F.lit(1.0) - poly * F.exp(-z * z)
    return F.signum(_c(x)) * y


def normal_cdf(x, sigma=1.0) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(_c(x) / (F.lit(sigma) * F.lit(math.sqrt(2.0)))))


def gauss(u) -> Column:
    """Standard normal density at u."""
    return F.exp(-F.lit(0.5) * _c(u) * _c(u)) / F.lit(math.sqrt(2.0 * math.pi))


def gauss_d1(u) -> Column:
    return -_c(u) * gauss(u)


def gauss_d2(u) -> Column:
    return (_c(u) * _c(u) - F.lit(1.0)) * gauss(u)


# ------------------------------------------------------------ vectors

def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def sqdist(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def tanimoto_dense(a, b) -> Column:
    """a.b / (a.a + b.b - a.b)."""
    ab = dot(a, b)
    return ab / (dot(a, a) + dot(b, b) - ab)


def kernel(kind: str, a, b, gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> Column:
    """linear, polynomial, rbf, sigmoid or tanimoto^degree kernel between two dense arrays."""
    if kind == "linear":
        return dot(a, b)
    if kind == "polynomial":
        return F.pow(F.lit(gamma) * dot(a, b) + F.lit(coef0), F.lit(float(degree)))
    if kind == "rbf":
        return F.exp(-F.lit(gamma) * sqdist(a, b))
    if kind == "sigmoid":
        return F.tanh(F.lit(gamma) * dot(a, b) + F.lit(coef0))
    if kind == "tanimoto":
        return F.pow(tanimoto_dense(a, b), F.lit(float(degree)))
    raise ValueError(f"Unknown kernel {kind}")


def dense_to_text(a) -> Column:
    """Dense vector text form: values joined by '|'."""
    return F.array_join(F.transform(_c(a), lambda x: x.cast("string")), "|")


def text_to_dense(s) -> Column:
    return F.transform(F.split(_c(s), r"\|"), lambda x: x.cast("double"))


def sparse_to_text(length, indices, values) -> Column:
    """Sparse vector text form ``length:indices:values`` with the inner lists joined by '|'."""
    return F.concat_ws(
        ":",
        _c(length).cast("string"),
        F.array_join(F.transform(_c(indices), lambda x: x.cast("string")), "|"),
        F.array_join(F.transform(_c(values), lambda x: x.cast("string")), "|"),
    )


def text_to_sparse(s) -> Column:
    parts = F.split(_c(s), ":")
    idx = F.when(parts[1] == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(parts[1], r"\|"), lambda x: x.cast("int")))
    val = F.when(parts[2] == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(parts[2], r"\|"), lambda x: x.cast("double")))
    return F.struct(parts[0].cast("int").alias("length"), idx.alias("indices"), val.alias("values"))


def half_beta(x, a) -> Column:
    """Regularised incomplete beta function I_x(a, 1/2), by its continued fraction with a bounded number of terms."""
    x, a = _c(x), _c(a)
    half = F.lit(0.5)
    # ln (gamma(a + 1/2) / gamma(a)): the series for large arguments, reached from a by 16 steps of the recurrence
    up = a + 16
    ratio = 0.5 * F.ln(up) - 1 / (8 * up) + 1 / (192 * F.pow(up, F.lit(3.0))) - 1 / (640 * F.pow(up, F.lit(5.0)))
    for i in range(16):
        ratio = ratio + F.ln((a + i) / (a + (i + 0.5)))
    front = F.exp(a * F.ln(x) + half * F.ln(1 - x) + ratio) / F.sqrt(F.lit(math.pi))

    def fraction(p: Column, q: Column, z: Column) -> Column:
        terms = F.least(F.lit(20_000.0), 100 + 8 * F.sqrt(F.greatest(p, q))).cast("int")

        def step(f: Column, k: Column) -> Column:
            m = F.floor(k / 2)
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / f

        return F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), step)

    near = front / (a * fraction(a, half, x))
    far = 1 - front / (half * fraction(half, a, 1 - x))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + 2.5), near).otherwise(far)


def t_two_sided(t, dof) -> Column:
    """Two-sided p-value of Student's t with ``dof`` degrees of freedom."""
    t, dof = _c(t), _c(dof).cast("double")
    return half_beta(dof / (dof + t * t), dof / 2)
