"""Projection, filters, updates, labels, duplicates, checks."""

from pyspark.sql import functions as F

from panelspark.catalog.registry import gt, query
from panelspark.functions.missing import is_true, m_div, m_ge, m_gt, m_le, m_lt, m_ne
from panelspark.operators import checks as C, clean as O
from panelspark.operators.merge import merge_report
from panelspark.plans import inputs as I, panel as P


@query("project", "employee l, day s, pay_amount d", "SELECT emp AS employee, day, pay_amount FROM @pay")
def q_project(spark, sf):
    return O.project(I.pay(spark, sf), ["emp", "day", "pay_*"], {"emp": "employee"})


@query("filter_missing_aware", "emp l, day s, rate d, div l", f"""
    SELECT emp, day, rate, div FROM @pay
    WHERE {gt('rate', '30')} OR coalesce(div <= 801, false)""")
def q_filter_missing_aware(spark, sf):
    return O.filter_missing_aware(I.pay(spark, sf), m_gt(F.col("rate"), 30) | m_le(F.col("div"), 801))


@query("missing_compare", "day s, rate_gt l, rate_ge l, rate_lt l, rate_le l, differs l, ratio d", f"""
    SELECT day, sum({gt('rate', '30')}::INT) AS rate_gt, sum(coalesce(rate >= 30, true)::INT) AS rate_ge,
           sum(coalesce(rate < 30, false)::INT) AS rate_lt, sum(coalesce(rate <= 30, false)::INT) AS rate_le,
           sum((rate IS DISTINCT FROM div)::INT) AS differs, sum(rate / nullif(hours - 3, 0)) AS ratio
    FROM @pay GROUP BY day""")
def q_missing_compare(spark, sf):
    r, n = F.col("rate"), lambda c: F.sum(c.cast("int"))
    return I.pay(spark, sf).groupBy("day").agg(
        n(m_gt(r, 30)).alias("rate_gt"), n(m_ge(r, 30)).alias("rate_ge"), n(m_lt(r, 30)).alias("rate_lt"),
        n(m_le(r, 30)).alias("rate_le"), n(m_ne(r, F.col("div"))).alias("differs"),
        F.sum(m_div(r, F.col("hours") - 3)).alias("ratio"))


@query("termination_end", "emp l, date_end s", f"""
    SELECT emp, CASE WHEN {gt('term', "DATE '2024-01-25'")} THEN DATE '2024-01-25' ELSE term END AS date_end FROM @people""")
def q_termination_end(spark, sf):
    """An open end is later than the window, so it becomes the window's end."""
    import datetime as dt
    end = F.lit(dt.date(2024, 1, 25))
    return O.conditional_update(I.people(spark, sf), [
        ("date_end", m_gt(F.col("term"), end), end), ("date_end", m_le(F.col("term"), end), F.col("term"))])


@query("conditional_update", "rec l, hours d, tier s", """
    SELECT rec, CASE WHEN hours < 0 THEN 0 ELSE hours END AS hours,
           CASE WHEN rate IS NULL THEN 'none' WHEN rate > 30 AND hours > 6 THEN 'top'
                WHEN hours <= 0 THEN 'void' ELSE 'base' END AS tier FROM @pay""")
def q_conditional_update(spark, sf):
    h, r = F.col("hours"), F.col("rate")
    return O.conditional_update(I.pay(spark, sf), [
        ("hours", h < 0, F.lit(0.0)), ("tier", None, F.lit("base")), ("tier", h == 0, F.lit("void")),
        ("tier", (r > 30) & (h > 6), F.lit("top")), ("tier", r.isNull(), F.lit("none"))])


@query("paycode_flag", "rec l, is_ot l, is_iod l, is_sick l", """
    SELECT rec, contains(lower(label), 'overtime')::INT AS is_ot, contains(lower(label), ' iod ')::INT AS is_iod,
           contains(lower(label), 'sick')::INT AS is_sick FROM @coded""")
def q_paycode_flag(spark, sf):
    return O.paycode_flag(P.coded(spark, sf), "label", {"is_ot": "overtime", "is_iod": " IOD ", "is_sick": "sick"})


@query("hours_split", "rec l, ot_hours d, std_hours d", """
    SELECT rec, CASE WHEN work = 1 AND contains(lower(label), 'overtime') THEN hours ELSE 0 END AS ot_hours,
           CASE WHEN contains(lower(label), 'overtime') THEN 0 ELSE hours END AS std_hours FROM @coded""")
def q_hours_split(spark, sf):
    return O.hours_split(P.coded(spark, sf), "hours", "label", "work")


@query("dedup_all", "emp l, day s, code s, div l", "SELECT DISTINCT emp, day, code, div FROM @pay")
def q_dedup_all(spark, sf):
    return O.dedup_all(I.pay(spark, sf).select("emp", "day", "code", "div"))


@query("dedup_key_first", "emp l, day s, div l, hours d, rec l", """
    SELECT emp, day, div, hours, rec FROM
      (SELECT *, row_number() OVER (PARTITION BY emp, day ORDER BY div NULLS LAST, rec) AS i FROM @pay) WHERE i = 1""")
def q_dedup_key_first(spark, sf):
    return O.dedup_key_first(I.pay(spark, sf).select("emp", "day", "div", "hours", "rec"), ["emp", "day"], ["div", "rec"])


@query("date_window", "l_orderkey l, l_linenumber l, l_shipdate s, l_quantity d", """
    SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, l_quantity FROM lineitem
    WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'""")
def q_date_window(spark, sf):
    import datetime as dt
    li = I.table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"])
    w = O.date_window(li, "l_shipdate", dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1))
    return w.withColumn("l_shipdate", F.to_date("l_shipdate"))


@query("drop_entity_if_any", "emp l, n l, hours d", """
    SELECT emp, count(*) AS n, sum(hours) AS hours FROM @pay
    WHERE emp NOT IN (SELECT emp FROM @pay WHERE hours >= 12 AND code = 'view') GROUP BY emp""")
def q_drop_entity_if_any(spark, sf):
    p = O.drop_entity_if_any(I.pay(spark, sf), ["emp"], (F.col("hours") >= 12) & (F.col("code") == "view"))
    return p.groupBy("emp").agg(F.count("*").alias("n"), F.sum("hours").alias("hours"))


@query("drop_entity_if_none", "emp l, n l", """
    SELECT emp, count(*) AS n FROM @pay WHERE emp IN (SELECT emp FROM @claims) GROUP BY emp""")
def q_drop_entity_if_none(spark, sf):
    hit = (F.col("code") == "error") & (F.col("pay_amount") > 100)
    return O.drop_entity_if_any(I.pay(spark, sf), ["emp"], hit, none=True).groupBy("emp").agg(F.count("*").alias("n"))


@query("recode_sentinel", "emp l, day s, rate d, rate_sentinel l", f"""
    SELECT emp, day, CASE WHEN {gt('max(rate)', '30')} THEN NULL ELSE max(rate) END AS rate,
           {gt('max(rate)', '30')}::INT AS rate_sentinel FROM @pay GROUP BY emp, day""")
def q_recode_sentinel(spark, sf):
    top = I.pay(spark, sf).groupBy("emp", "day").agg(F.max("rate").alias("rate"))
    return O.recode_sentinel(top, "rate", m_gt(F.col("rate"), 30))


@query("destring_clean", "emp l, day s, amount d", """
    SELECT emp, day, try_cast(replace(format('{:,.2f}', medpd * 100), ',', '') AS DOUBLE) AS amount FROM @claims""")
def q_destring_clean(spark, sf):
    text = F.format_number(F.col("medpd") * 100, 2)
    return O.destring_clean(I.claims(spark, sf).withColumn("text", text), "text", ",", out="amount")


@query("manual_override", "emp l, day s, div l, overridden l", """
    SELECT p.emp, p.day, CASE WHEN s.s_suppkey IS NOT NULL AND (p.div IS NULL OR p.div < 804) THEN 900 + s.s_nationkey ELSE p.div END AS div,
           (s.s_suppkey IS NOT NULL AND (p.div IS NULL OR p.div < 804))::INT AS overridden
    FROM @pay p LEFT JOIN supplier s ON p.emp = s.s_suppkey""")
def q_manual_override(spark, sf):
    """Corrections listed per person (here one per supplier key) for low or unknown divisions."""
    o = I.table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"]).select(
        F.col("s_suppkey").alias("emp"), (900 + F.col("s_nationkey")).alias("div"))
    return O.manual_override(I.pay(spark, sf), o, ["emp"], "div", F.col("div").isNull() | (F.col("div") < 804))


@query("division_lookup", "div l, name s", """
    SELECT DISTINCT p.div, n.n_name AS name FROM @pay p JOIN nation n ON n.n_nationkey = p.div - 800 WHERE p.div > 802""")
def q_division_lookup(spark, sf):
    n = I.table(spark, sf, "nation").select((800 + F.col("n_nationkey")).alias("div"), F.col("n_name").alias("name"))
    return O.division_lookup(I.pay(spark, sf).join(n, "div"), "div", "name", above=802)


@query("case_label", "code s, cat s", """
    SELECT code, CASE WHEN out_type = 1 THEN 'leave' WHEN work = 1 THEN 'work' ELSE 'other' END AS cat FROM @codes""")
def q_case_label(spark, sf):
    return O.case_label(I.codes(spark, sf), "cat", [(F.col("work") == 1, "work"), (F.col("out_type") == 1, "leave")], "other")


@query("text_normalize", "rec l, nature s", """
    SELECT rec, replace(CASE WHEN contains(nature, ' (e.g.,') THEN replace(nature, ' (e.g.,', '')
                     WHEN contains(nature, 'Mult ') THEN replace(replace(nature, 'Mult', 'Multiple'), 'Incl ', 'Including ')
                     ELSE nature END, ',', '') AS nature FROM @claims""")
def q_text_normalize(spark, sf):
    return O.text_normalize(I.claims(spark, sf), "nature", [
        ("Mult ", "Mult", "Multiple"), ("Incl ", "Incl ", "Including "), (" (e.g.,", " (e.g.,", ""), (",", ",", "")])


@query("check_unique", "table s, check s, n_violations l, ok l", """
    SELECT *, (n_violations = 0)::INT AS ok FROM (
      SELECT 'daily' AS table, 'duplicate_keys' AS check, (SELECT count(*) FROM (SELECT 1 FROM @daily GROUP BY emp, day HAVING count(*) > 1)) AS n_violations
      UNION ALL SELECT 'daily', 'missing_key_rows', (SELECT count(*) FROM @daily WHERE emp IS NULL OR day IS NULL)
      UNION ALL SELECT 'pay', 'duplicate_keys', (SELECT count(*) FROM (SELECT 1 FROM @pay GROUP BY emp, day, div HAVING count(*) > 1))
      UNION ALL SELECT 'pay', 'missing_key_rows', (SELECT count(*) FROM @pay WHERE div IS NULL))""")
def q_check_unique(spark, sf):
    a = C.check_unique(P.daily(spark, sf), ["emp", "day"]).withColumn("table", F.lit("daily"))
    return a.unionByName(C.check_unique(I.pay(spark, sf), ["emp", "day", "div"]).withColumn("table", F.lit("pay")))


@query("check_not_missing", "check s, n_violations l, ok l", """
    SELECT *, (n_violations = 0)::INT AS ok FROM (
      SELECT 'code' AS check, count(*) FILTER (code IS NULL) AS n_violations FROM @pay
      UNION ALL SELECT 'div', count(*) FILTER (div IS NULL) FROM @pay
      UNION ALL SELECT 'rate where div', count(*) FILTER (div IS NOT NULL AND rate IS NULL) FROM @pay)""")
def q_check_not_missing(spark, sf):
    return C.check_not_missing(I.pay(spark, sf), {"code": "code", "div": "div", "rate where div": ("div", "rate")})


@query("check_bounds", "check s, n_violations l, ok l", """
    SELECT *, (n_violations = 0)::INT AS ok FROM (
      SELECT 'hours range' AS check, count(*) FILTER (hours NOT BETWEEN -12 AND 12) AS n_violations FROM @pay
      UNION ALL SELECT 'hours positive', count(*) FILTER (hours <= 0) FROM @pay
      UNION ALL SELECT 'rate if worked', count(*) FILTER (code = 'click' AND coalesce(rate >= 30, true)) FROM @pay)""")
def q_check_bounds(spark, sf):
    return C.check_bounds(I.pay(spark, sf), {
        "hours range": F.col("hours").between(-12, 12), "hours positive": F.col("hours") > 0,
        "rate if worked": (F.col("code") != "click") | m_lt(F.col("rate"), 30)})


@query("check_count", "check s, n_violations l, ok l", """
    SELECT 'three-unit days' AS check, abs(count(*) FILTER (n_slots > 2) - 27) AS n_violations,
           (count(*) FILTER (n_slots > 2) = 27)::INT AS ok FROM @daily""")
def q_check_count(spark, sf):
    return C.check_count(P.daily(spark, sf), "three-unit days", F.col("n_slots") > 2, 27)


@query("check_match", "check s, n_violations l, ok l", """
    WITH m AS (SELECT CASE WHEN p.emp IS NULL THEN 2 WHEN c.emp IS NULL THEN 1 ELSE 3 END AS k
               FROM @daily p FULL JOIN @claims c ON p.emp = c.emp AND p.day = c.day)
MAIN SELECT *, (n_violations = 0)::INT AS ok FROM (
      SELECT 'no claim without day' AS check, count(*) FILTER (k = 2) AS n_violations FROM m
      UNION ALL SELECT 'every day has claim', count(*) FILTER (k = 1) FROM m)""")
def q_check_match(spark, sf):
    m, _ = merge_report(P.daily(spark, sf), I.claims(spark, sf), ["emp", "day"])
    return C.check_match(m, {"no claim without day": [2], "every day has claim": [1]})


@query("constancy_in_group", "check s, n_violations l, ok l", """
    SELECT *, (n_violations = 0)::INT AS ok FROM (
      SELECT 'job_class' AS check, count(*) FILTER (a > 1) AS n_violations FROM
        (SELECT count(DISTINCT job_class) AS a FROM @leave_panel GROUP BY emp)
      UNION ALL SELECT 'main_div', count(*) FILTER (a > 1) FROM
        (SELECT count(DISTINCT main_div) AS a FROM @leave_panel GROUP BY emp)
      UNION ALL SELECT 'div1', count(*) FILTER (a > 1) FROM
        (SELECT count(DISTINCT coalesce(div1, -1)) AS a FROM @leave_panel GROUP BY emp))""")
def q_constancy_in_group(spark, sf):
    return C.constancy_in_group(P.leave_panel(spark, sf), ["emp"], ["job_class", "main_div", "div1"])
