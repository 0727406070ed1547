"""Query registry and the shared SQL views behind the comparison SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

def parse_out(out: str) -> list[tuple[str, str]]:
    """'emp l, day s, share d' -> [(name, kind)]: long, string, or double rounded to 6 digits.

    The rounding to 10 digits before it removes noise around exact halves.
    """
    return [tuple(part.split()) for part in out.split(",")]


def tidy(df: DataFrame, out: str) -> DataFrame:
    put = {"l": lambda c: c.cast("bigint"), "s": lambda c: c.cast("string"),
           "d": lambda c: F.round(F.round(c.cast("double"), 10), 6) + F.lit(0.0)}
    return df.select(*[put[k](F.col(n)).alias(n) for n, k in parse_out(out)])


def tidy_sql(sql: str, out: str) -> str:
    put = {"l": "CAST({0} AS BIGINT)", "s": "CAST({0} AS VARCHAR)",
           "d": "round(round(CAST({0} AS DOUBLE), 10), 6) + 0.0::DOUBLE"}
    cols = ", ".join(put[k].format(f'"{n}"') + f' AS "{n}"' for n, k in parse_out(out))
    if sql.lstrip().upper().startswith("WITH "):
        head, body = sql.rsplit("\nMAIN ", 1)
        return f"{head}\nSELECT {cols} FROM ({body})"
    return f"SELECT {cols} FROM ({sql})"


def query(name: str, out: str, sql: str | None = None):
    """Register a query under its operator's name, with comparison SQL if there is any.

    A comparison text may start with its own WITH list; its main part then starts on a
    new line after the word MAIN.
    """
    def add(fn):
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf), out)
        if sql:
            SQL[name] = expand(tidy_sql(sql, out))
        return fn
    return add


LEAVE = "leave_hours >= 8 AND worked_hours = 0"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
ONWARD = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def gt(a: str, b: str) -> str:
    """a > b where a missing value is largest."""
    return f"coalesce({a} > {b}, {a} IS NULL AND {b} IS NOT NULL)"


VIEWS = {
    "people": """
        SELECT c_custkey AS emp, c_mktsegment AS job_class, 800 + c_nationkey % 8 AS home_div,
               DATE '2023-12-15' + ((c_custkey * 7) % 25)::INT AS hire,
               CASE WHEN c_custkey % 5 = 0 THEN DATE '2024-01-20' + (c_custkey % 15)::INT END AS term
        FROM customer""",
    "codes": """
        SELECT DISTINCT event_type AS code,
               CASE event_type WHEN 'click' THEN 'Regular Hours' WHEN 'view' THEN 'Overtime Hours'
                    WHEN 'purchase' THEN 'Vacation, Paid' WHEN 'signup' THEN 'Sick 100% Pay'
                    ELSE 'On Duty IOD Hours' END AS label,
               CASE WHEN event_type IN ('click', 'view') THEN 1 END AS work,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 1 END AS out_type,
               CASE WHEN event_type = 'signup' THEN 1 END AS sick_subset
        FROM events""",
    "pay": """
        SELECT event_id AS rec, emp, CAST(ts AS DATE) AS day, event_type AS code,
               CASE WHEN event_id % 97 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (floor(value)::BIGINT % 12 + 1) AS hours,
               value AS pay_amount,
               CASE WHEN event_id % 41 <> 0 THEN 20.0::DOUBLE + event_id % 15 END AS rate,
               CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 800 + (home_div - 799) % 8
                    ELSE home_div END AS div,
               25.0::DOUBLE + emp % 35 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 365.25::DOUBLE AS age
        FROM events JOIN @people ON user_id = emp""",
    "claims": """
        SELECT emp, day, rec, CASE WHEN rec % 3 <> 0 THEN pay_amount END AS medpd,
               CASE rec % 4 WHEN 0 THEN 'Strain' WHEN 1 THEN 'Mult Injuries Incl Cuts'
                    WHEN 2 THEN 'Sprain, Ankle (e.g., left)' ELSE 'Burn, Heat' END AS nature
        FROM (SELECT *, row_number() OVER (PARTITION BY emp, day ORDER BY rec) AS i FROM @pay
              WHERE code = 'error' AND pay_amount > 100) WHERE i = 1""",
    "days": "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events",
    "holidays": "SELECT day, 'Public holiday' AS holiday FROM @days WHERE dayofmonth(day) IN (1, 15)",
    "weather": "SELECT day, (dayofmonth(day) * 7 % 10) / 10.0::DOUBLE AS prcp FROM @days WHERE day >= DATE '2024-01-03'",
    "contacts": "SELECT DISTINCT day, div, emp FROM @pay WHERE code IN ('click', 'view') AND div IS NOT NULL",
    "coded": "SELECT p.*, c.label, c.work, c.out_type, c.sick_subset FROM @pay p LEFT JOIN @codes c USING (code)",
    "classified": """
        SELECT * REPLACE (CASE WHEN div >= 800 THEN div END AS div),
               CASE WHEN work = 1 AND contains(lower(label), 'overtime') THEN hours ELSE 0 END AS ot_hours,
               CASE WHEN contains(lower(label), 'overtime') THEN 0 ELSE hours END AS std_hours,
               CASE WHEN out_type = 1 THEN code ELSE 'not leave' END AS kind,
               CASE WHEN contains(label, 'IOD') THEN 1 END AS iod,
               pay_amount * contains(lower(label), 'overtime')::INT AS ot_pay, pay_amount * work AS work_pay
        FROM @coded
        WHERE (work = 1 OR out_type = 1 OR contains(label, 'IOD'))
          AND NOT coalesce(work = 1 AND pay_amount / nullif(hours, 0) = 0, false)""",
    "per_code": """
        SELECT emp, day, div, kind, sick_subset, sum(hours) AS hours, sum(std_hours) AS std_hours,
               sum(ot_hours) AS ot_hours, coalesce(sum(work_pay), 0) AS work_pay, coalesce(sum(ot_pay), 0) AS ot_pay,
               max(iod) AS iod, max(rate) AS rate
        FROM @classified GROUP BY ALL""",
    "daily_div": """
        SELECT emp, day, div,
               sum(CASE WHEN kind = 'not leave' THEN hours ELSE 0 END) AS worked_hours,
               sum(CASE WHEN kind <> 'not leave' THEN greatest(hours, 0) ELSE 0 END) AS leave_hours,
               sum(CASE WHEN sick_subset = 1 THEN CASE WHEN kind <> 'not leave' THEN greatest(hours, 0) ELSE hours END
                        ELSE 0 END) AS sick_hours,
               sum(std_hours) AS std_hours, sum(ot_hours) AS ot_hours, sum(work_pay) AS work_pay,
               sum(ot_pay) AS ot_pay, max(iod) AS iod, max(rate) AS rate
        FROM @per_code GROUP BY ALL""",
    "slots": """
        SELECT *, row_number() OVER (PARTITION BY emp, day ORDER BY worked_hours, div NULLS LAST) AS i FROM @daily_div""",
    "daily": f"""
        SELECT * REPLACE (last_value(rate IGNORE NULLS) OVER (PARTITION BY emp ORDER BY day {UPTO}) AS rate)
        FROM (SELECT emp, day, max(div) FILTER (i = 1) AS div1, max(div) FILTER (i = 2) AS div2,
                     max(leave_hours) FILTER (i = 1) AS leave_1, max(leave_hours) FILTER (i = 2) AS leave_2,
                     max(sick_hours) FILTER (i = 1) AS sick_1, max(sick_hours) FILTER (i = 2) AS sick_2,
                     count(*) AS n_slots, greatest(sum(worked_hours), 0) AS worked_hours,
                     (sum(worked_hours) < 0)::INT AS hours_zeroed, sum(leave_hours) AS leave_hours,
                     sum(sick_hours) AS sick_hours, sum(std_hours) AS std_hours, sum(ot_hours) AS ot_hours,
                     sum(work_pay) AS work_pay, sum(ot_pay) AS ot_pay, max(iod) AS iod,
                     CASE WHEN max(rate) <= 34 THEN max(rate) END AS rate
              FROM @slots GROUP BY emp, day)""",
    "skeleton": f"""
        SELECT emp, unnest(generate_series(greatest(hire, DATE '2024-01-01'),
                 CASE WHEN {gt('term', "DATE '2024-01-30'")} THEN DATE '2024-01-30' ELSE term END,
                 INTERVAL 1 DAY))::DATE AS day
        FROM @people""",
    "filled": f"""
        SELECT s.emp, s.day, d.div1, d.div2, coalesce(d.worked_hours, 0) AS worked_hours,
               coalesce(d.leave_hours, 0) AS leave_hours, coalesce(d.sick_hours, 0) AS sick_hours,
               coalesce(d.std_hours, 0) AS std_hours, coalesce(d.ot_hours, 0) AS ot_hours, d.work_pay, d.ot_pay,
               last_value(d.rate IGNORE NULLS) OVER w AS rate,
               (c.emp IS NOT NULL AND d.emp IS NOT NULL)::INT AS injured, c.medpd, c.nature, (d.emp IS NOT NULL)::INT AS seen,
               (coalesce(d.worked_hours, 0) = 0)::INT AS not_worked,
               sum(coalesce(d.worked_hours, 0)) OVER w AS cum_worked, sum(coalesce(d.std_hours, 0)) OVER w AS cum_std,
               sum(coalesce(d.ot_hours, 0)) OVER w AS cum_ot,
               max((d.emp IS NOT NULL)::INT) OVER (PARTITION BY s.emp) AS ever_seen
        FROM @skeleton s LEFT JOIN @daily d ON s.emp = d.emp AND s.day = d.day
             LEFT JOIN @claims c ON s.emp = c.emp AND s.day = c.day
        WINDOW w AS (PARTITION BY s.emp ORDER BY s.day {UPTO})""",
    "panel": f"""
        SELECT f.* EXCLUDE (ever_seen), p.job_class, p.hire, w.prcp, (h.day IS NOT NULL)::INT AS is_holiday,
               {gt('w.prcp', '0')}::INT AS rain,
               (year(f.day) - 1960) * 52 + least(ceil(dayofyear(f.day) / 7.0), 52)::INT - 1 AS week_ix,
               (year(f.day) - 1960) * 12 + month(f.day) - 1 AS month_ix
        FROM @filled f JOIN @people p USING (emp) LEFT JOIN @weather w ON f.day = w.day
             LEFT JOIN @holidays h ON f.day = h.day
        WHERE ever_seen = 1""",
    "main_division": """
        SELECT emp, day, div AS main_div FROM
          (SELECT *, row_number() OVER (PARTITION BY emp, day ORDER BY div NULLS LAST) AS i FROM @pay
           WHERE code = 'click' AND hours >= 0) WHERE i = 1""",
    "fill1": f"""
        SELECT p.*, coalesce(last_value(m.main_div IGNORE NULLS) OVER (PARTITION BY p.emp ORDER BY p.day {UPTO}),
                             CASE WHEN div2 IS NULL THEN div1 END) AS m1
        FROM @panel p LEFT JOIN @main_division m ON p.emp = m.emp AND p.day = m.day""",
    "fill2": f"SELECT *, last_value(m1 IGNORE NULLS) OVER (PARTITION BY emp ORDER BY day {UPTO}) AS m2 FROM @fill1",
    "fill3": f"SELECT * EXCLUDE (m1, m2), first_value(m2 IGNORE NULLS) OVER (PARTITION BY emp ORDER BY day {ONWARD}) AS main_div FROM @fill2",
    "based": f"""
        SELECT *, (leave_hours > 0)::INT AS took_leave, ({LEAVE})::INT AS out_today,
               date_diff('day', hire, day) AS tenure_days, date_diff('day', hire, day) / 365.25::DOUBLE AS tenure
        FROM @fill3 WHERE main_div IS NOT NULL AND day >= hire""",
    "ranked": """
        SELECT *, rank() OVER (PARTITION BY main_div, day ORDER BY tenure DESC) AS rank_div,
               rank() OVER (PARTITION BY day ORDER BY tenure DESC) AS rank_org,
               count(*) OVER g AS div_size, sum(took_leave) OVER g - took_leave AS others_leave,
               sum((leave_hours - sick_hours >= 8)::INT) OVER g - (leave_hours - sick_hours >= 8)::INT AS others_leave_nosick,
               sum(out_today) OVER g - out_today AS others_out,
               sum(CASE WHEN worked_hours = 0 THEN leave_hours ELSE 0 END) OVER g
                 - CASE WHEN worked_hours = 0 THEN leave_hours ELSE 0 END AS others_leave_hours
        FROM @based WINDOW g AS (PARTITION BY main_div, day)""",
    "prior": """
        SELECT a.*, CASE WHEN a.div_size = 1 THEN 0 ELSE a.others_leave / (a.div_size - 1)::DOUBLE END AS others_leave_share,
               w.rank_div AS rank_div_lastweek, m.rank_org AS rank_org_lastmonth
        FROM @ranked a
        LEFT JOIN @ranked w ON w.emp = a.emp AND w.day = a.day - (dayofweek(a.day) + 1)::INT
        LEFT JOIN @ranked m ON m.emp = a.emp AND m.day = date_trunc('month', a.day)::DATE - 1""",
    "leave_panel": """
        SELECT a.*,
          (SELECT count(*) FROM @ranked b WHERE b.main_div = a.main_div AND b.day = a.day AND b.out_today = 1
             AND b.rank_div > a.rank_div) AS out_below,
          (SELECT count(*) FROM @ranked b WHERE b.main_div = a.main_div AND b.day = a.day AND b.out_today = 1
             AND b.rank_div < a.rank_div) AS out_above,
          (SELECT count(*) FROM @prior b WHERE b.day = a.day AND b.out_today = 1
             AND b.rank_org_lastmonth > a.rank_org_lastmonth) AS out_below_org,
          (SELECT count(*) FROM @prior b WHERE b.day = a.day AND b.out_today = 1 AND b.rank_org_lastmonth IS NOT NULL
             AND coalesce(b.rank_org_lastmonth < a.rank_org_lastmonth, true)) AS out_above_org
        FROM @prior a""",
    "windowed": """
        SELECT * FROM @prior WHERE day >= DATE '2024-01-02' AND day < DATE '2024-01-30'
          AND emp NOT IN (SELECT emp FROM @prior WHERE job_class = 'MACHINERY')""",
    "marks": """
        SELECT *, (injured = 1 AND worked_hours <= 0)::INT AS idle,
               coalesce(lead(injured = 1 AND worked_hours <= 0) OVER w AND worked_hours > 0, false)::INT AS takes,
               lead(medpd) OVER w AS next_medpd, lead(nature) OVER w AS next_nature
        FROM @windowed WINDOW w AS (PARTITION BY emp ORDER BY day)""",
    "shifted": """
        SELECT * EXCLUDE (idle, takes, next_medpd, next_nature, gives)
               REPLACE (CASE WHEN gives THEN 0 WHEN takes = 1 THEN 1 ELSE injured END AS injured,
                        CASE WHEN takes = 1 THEN next_medpd ELSE medpd END AS medpd,
                        CASE WHEN takes = 1 THEN next_nature ELSE nature END AS nature),
               takes AS shifted_here,
               (worked_hours > 0 OR CASE WHEN gives THEN 0 WHEN takes = 1 THEN 1 ELSE injured END = 1)::INT AS worked
        FROM (SELECT *, coalesce(lag(takes) OVER (PARTITION BY emp ORDER BY day) = 1, false) AS gives FROM @marks)""",
    "stints": f"""
        SELECT *, sum(new_run) OVER (PARTITION BY emp ORDER BY day {UPTO}) AS stint FROM
          (SELECT *, (active IS DISTINCT FROM lag(active) OVER (PARTITION BY emp ORDER BY day))::INT AS new_run FROM
            (SELECT *, (worked = 1 OR leave_hours > 0)::INT AS active,
                    sum(worked) OVER (PARTITION BY emp ORDER BY day {UPTO}) AS days_worked,
                    sum(worked) OVER (PARTITION BY emp) AS total_worked FROM @shifted)
           WHERE total_worked > 0)""",
    "lengths": "SELECT *, count(*) OVER (PARTITION BY emp, stint) AS stint_length FROM @stints",
    "modes": """
        SELECT emp, CASE WHEN count(*) = 1 THEN max(stint_length) END AS usual_stint FROM
          (SELECT emp, stint_length, rank() OVER (PARTITION BY emp ORDER BY count(*) DESC) AS r
           FROM @lengths WHERE active = 1 GROUP BY emp, stint_length) WHERE r = 1 GROUP BY emp""",
    "ages": """
        SELECT emp, age - date_diff('day', DATE '2024-01-01', day) / 365.25::DOUBLE AS age_ref FROM
          (SELECT *, row_number() OVER (PARTITION BY emp ORDER BY age, day) AS i FROM @pay) WHERE i = 1""",
    "means": """
        SELECT l.*, m.usual_stint, a.age_ref,
               a.age_ref + date_diff('day', DATE '2024-01-01', day) / 365.25::DOUBLE AS age,
               avg(others_out) OVER (PARTITION BY l.emp) AS bar_others_out, avg(rate) OVER (PARTITION BY l.emp) AS bar_rate
        FROM (SELECT *, min(CASE WHEN injured = 1 THEN day END) OVER (PARTITION BY emp) AS first_injury,
                     lag(main_div) OVER (PARTITION BY emp ORDER BY day) AS div_before FROM @lengths) l
             LEFT JOIN @modes m ON l.emp = m.emp LEFT JOIN @ages a ON l.emp = a.emp
        WHERE NOT (worked = 0 AND leave_hours > 0)""",
    "spells": f"""
        SELECT *, last_value(CASE WHEN injured = 1 THEN day END IGNORE NULLS)
                    OVER (PARTITION BY emp ORDER BY day {UPTO}) AS last_inj FROM @means""",
    "returns": """
        SELECT *, CASE WHEN last_inj IS NULL THEN min(day) OVER (PARTITION BY emp, last_inj)
                       WHEN worked = 1 AND row_number() OVER (PARTITION BY emp, last_inj, worked ORDER BY day) = 2 THEN day
                  END AS back0 FROM @spells""",
    "returns2": f"SELECT *, last_value(back0 IGNORE NULLS) OVER (PARTITION BY emp, last_inj ORDER BY day {UPTO}) AS back FROM @returns",
    "sample": """
        SELECT * EXCLUDE (back0, back, last_inj, new_run),
               (min(injured) OVER (PARTITION BY day) <> max(injured) OVER (PARTITION BY day))::INT AS day_varies,
               dayofweek(day) AS weekday, least(ceil(dayofyear(day) / 7.0), 52)::INT AS week
        FROM @returns2 WHERE injured = 1 OR (back IS NOT NULL AND day > back)""",
    "readings": """
        SELECT o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS date_text, min(o_totalprice) AS tmin,
               max(o_totalprice) AS tmax, count(*)::DOUBLE AS prcp FROM orders GROUP BY ALL""",
    # pairs of people at the same division and day, for brute-force checks of the network
    "sized": "SELECT *, count(*) OVER (PARTITION BY day, div) AS n FROM @contacts",
    "pairs": """
        SELECT a.day, a.emp AS i, b.emp AS j, sum(1.0::DOUBLE / (a.n - 1)) AS w
        FROM @sized a JOIN @sized b ON a.day = b.day AND a.div = b.div AND a.emp <> b.emp GROUP BY ALL""",
}


def expand(sql: str) -> str:
    """Replace @view by its name and put the views used, in order, in a WITH clause."""
    need: list[str] = []

    def visit(text: str) -> None:
        for v in re.findall(r"@(\w+)", text):
            if v not in VIEWS:
                raise KeyError(v)
            if v not in need:
                visit(VIEWS[v])
                if v not in need:
                    need.append(v)

    visit(sql)
    plain = lambda t: re.sub(r"@(\w+)", r"v_\1", t).strip()
    ctes = [f"v_{v} AS MATERIALIZED ({plain(VIEWS[v])})" for v in need]
    body = plain(sql)
    if body.upper().startswith("WITH "):
        rest = body[5:]
        recursive = rest.upper().startswith("RECURSIVE ")
        rest = rest[10:] if recursive else rest
        head = "WITH RECURSIVE " if recursive else "WITH "
        return head + ",\n".join([*ctes, rest]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
