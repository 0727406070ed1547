"""Column functions: text, calendar, rounding, the normal law, hash draws."""

from pyspark.sql import functions as F

from panelspark.catalog.registry import query
from panelspark.functions import dates as D
from panelspark.functions.draws import hash_normal2, hash_uniform
from panelspark.functions.normal import HART_DEN, HART_NUM, HART_SPLIT, SQRT_2PI, bvn_cdf, bvn_rule, norm_cdf, norm_inv, norm_pdf
from panelspark.plans import inputs as I, panel as P


@query("str_flags", "rec l, at l, low s, plain s, once s, num l, padded s", """
    SELECT rec, instr(label, 'Hours') AS at, lower(label) AS low, replace(label, ' ', '_') AS plain,
           replace(label, '%', chr(92) || '%') AS once, CAST(regexp_extract('PERSON ' || emp, '(\\d+)', 1) AS BIGINT) AS num,
           printf('%.2f', hours) AS padded FROM @coded""")
def q_str_flags(spark, sf):
    c = P.coded(spark, sf)
    return c.select("rec", F.instr("label", "Hours").alias("at"), F.lower("label").alias("low"),
                    F.replace("label", F.lit(" "), F.lit("_")).alias("plain"),
                    F.regexp_replace("label", "%", "\\\\%").alias("once"),
                    F.regexp_extract(F.concat(F.lit("PERSON "), F.col("emp").cast("string")), "(\\d+)", 1).alias("num"),
                    F.format_string("%.2f", "hours").alias("padded"))


@query("date_parts", "day s, y l, m l, mofd l, wofd l, wk l, dow l, sat s, eom s, yrs d, w4 l, n l", """
    SELECT day, year(day) AS y, month(day) AS m, (year(day) - 1960) * 12 + month(day) - 1 AS mofd,
           (year(day) - 1960) * 52 + least(ceil(dayofyear(day) / 7.0), 52) - 1 AS wofd, least(ceil(dayofyear(day) / 7.0), 52) AS wk,
           dayofweek(day) AS dow, day - dayofweek(day)::INT - 1 AS sat, date_trunc('month', day)::DATE - 1 AS eom,
           date_diff('day', DATE '1995-01-01', day) / 365.25::DOUBLE AS yrs,
           floor(((year(day) - 1960) * 52 + least(ceil(dayofyear(day) / 7.0), 52) - 1) / 4.0) AS w4, count(*) AS n
    FROM (SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem) GROUP BY day""")
def q_date_parts(spark, sf):
    d = I.table(spark, sf, "lineitem", ["l_shipdate"]).groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))
    wk = D.week_index("day")
    return d.select("day", F.year("day").alias("y"), F.month("day").alias("m"), D.month_index("day").alias("mofd"),
                    wk.alias("wofd"), D.week_of_year("day").alias("wk"), D.dow("day").alias("dow"), D.prior_week_end("day").alias("sat"),
                    D.prior_month_end("day").alias("eom"),
                    D.years_between("day", F.to_date(F.lit("1995-01-01"))).alias("yrs"), D.four_week(wk).alias("w4"), "n")


@query("round_to", "rec l, r2 d, r5 d, r01 d", """
    SELECT rec, floor(hours / 2 + 0.5) * 2 AS r2, floor(pay_amount / 5 + 0.5) * 5 AS r5, floor(pay_amount / 0.1 + 0.5) * 0.1::DOUBLE AS r01 FROM @pay""")
def q_round_to(spark, sf):
    return I.pay(spark, sf).select("rec", D.round_to("hours", 2).alias("r2"), D.round_to("pay_amount", 5).alias("r5"),
                                   D.round_to("pay_amount", 0.1).alias("r01"))


def cdf_text(x: str) -> str:
    """The distribution function of a named column as SQL text."""
    z = f"abs({x})"
    poly = lambda cs: "".join("(" for _ in cs[1:]) + f"{cs[0]!r}" + "".join(f" * {z} + {c!r})" for c in cs[1:])
    tail = f"({z} + 0.65)"
    for k in (4, 3, 2, 1):
        tail = f"({z} + {k} / {tail})"
    low = (f"(CASE WHEN {z} < {HART_SPLIT} THEN exp(-{z} * {z} / 2) * {poly(HART_NUM)} / {poly(HART_DEN)} "
           f"WHEN {z} <= 37 THEN exp(-{z} * {z} / 2) / {tail} / {SQRT_2PI!r} ELSE 0 END)")
    return f"(CASE WHEN {x} > 0 THEN 1 - {low} ELSE {low} END)"


def series_text(x: str, terms: int = 60) -> str:
    """The same function by its power series, an independent check for moderate values."""
    return (f"(0.5 + exp(-{x} * {x} / 2) / {SQRT_2PI!r} * list_sum(list_transform(range(0, {terms}), "
            f"lambda k: {x} ** (2 * k + 1) / list_product(list_transform(range(0, k + 1), lambda j: (2 * j + 1)::DOUBLE)))))")


@query("norm_cdf", "rec l, p d, dens d", f"""
    SELECT rec, {series_text('x')} AS p, exp(-x * x / 2) / {SQRT_2PI!r} AS dens FROM (SELECT rec, hours / 4.0::DOUBLE AS x FROM @pay)""")
def q_norm_cdf(spark, sf):
    p = I.pay(spark, sf).withColumn("x", F.col("hours") / 4)
    return p.select("rec", norm_cdf("x").alias("p"), norm_pdf("x").alias("dens"))


def inv_sql() -> str:
    """Quantiles by Newton steps on the distribution function, five rounds from zero-ish starts."""
    steps = ["SELECT DISTINCT u, CASE WHEN u < 0.5 THEN -sqrt(-2 * ln(u)) ELSE sqrt(-2 * ln(1 - u)) END * 0.8 AS x FROM src"]
    ctes = ["src AS (SELECT rec, (rec % 997 + 0.5) / 997.0::DOUBLE AS u FROM @pay)", f"n0 AS ({steps[0]})"]
    for i in range(1, 9):
        ctes.append(f"n{i} AS MATERIALIZED (SELECT u, x - greatest(-0.5, least(0.5, ({cdf_text('x')} - u) / (exp(-x * x / 2) / {SQRT_2PI!r}))) AS x FROM n{i - 1})")
    return "WITH " + ",\n".join(ctes) + "\nMAIN SELECT rec, x AS q FROM src JOIN n8 USING (u)"


@query("norm_inv", "rec l, q d", inv_sql())
def q_norm_inv(spark, sf):
    u = (F.col("rec") % 997 + 0.5) / F.lit(997.0)
    return I.pay(spark, sf).withColumn("u", u).select("rec", norm_inv("u").alias("q"))


BVN_SQL = " + ".join(f"({w!r}::DOUBLE * exp(-(h * h + k * k - 2 * h * k * {s!r}::DOUBLE) / {2 * (1 - s * s)!r}::DOUBLE))" for w, s in bvn_rule(-0.6))


@query("bvn_cdf", "rec l, p d", f"""
    SELECT rec, {cdf_text('h')} * {cdf_text('k')} + {BVN_SQL} AS p
    FROM (SELECT rec, hours / 5.0::DOUBLE AS h, (pay_amount - 60) / 50 AS k FROM @pay)""")
def q_bvn_cdf(spark, sf):
    p = I.pay(spark, sf).select("rec", (F.col("hours") / 5).alias("h"), ((F.col("pay_amount") - 60) / 50).alias("k"))
    return p.select("rec", bvn_cdf("h", "k", -0.6).alias("p"))


def u_sql(seed: str, *cols: str) -> str:
    key = " || '|' || ".join([f"'{seed}'", *cols])
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


@query("hash_uniform", "rec l, u d, v d", f"SELECT rec, {u_sql('7', 'rec')} AS u, {u_sql('7', 'emp', 'rec')} AS v FROM @pay")
def q_hash_uniform(spark, sf):
    return I.pay(spark, sf).select("rec", hash_uniform(7, "rec").alias("u"), hash_uniform(7, "emp", "rec").alias("v"))


@query("hash_normal2", "rec l, e1 d, e2 d", f"""
    WITH b AS (SELECT rec, sqrt(-2 * ln({u_sql('3a', 'rec')})) AS r, 2 * pi() * {u_sql('3b', 'rec')} AS t FROM @pay)
MAIN SELECT rec, r * cos(t) AS e1, -0.6 * r * cos(t) + 0.8::DOUBLE * r * sin(t) AS e2 FROM b""")
def q_hash_normal2(spark, sf):
    e1, e2 = hash_normal2(3, -0.6, "rec")
    return I.pay(spark, sf).select("rec", e1.alias("e1"), e2.alias("e2"))
