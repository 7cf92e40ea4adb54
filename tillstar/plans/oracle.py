"""DuckDB SQL giving the same results as the registered queries.

The driver tables are visible as views (``lineitem``, ``orders`` ...).  The
warehouse star and the dirty export are rebuilt here as CTEs with the same
integer-cents arithmetic as the Spark plans, so both engines agree exactly.
"""

from __future__ import annotations

from tillstar.plans import params as P

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_QTY = "CAST(l_quantity AS BIGINT)"


def _money(cents: str, dtype: str = "DECIMAL(8,2)") -> str:
    return f"CAST(CAST({cents} AS DECIMAL(18,0)) * 0.01 AS {dtype})"


def _half_up(num: str, den: str) -> str:
    mag = f"((2 * abs({num}) + ({den})) // (2 * ({den})))"
    return f"(CASE WHEN {num} < 0 THEN -{mag} ELSE {mag} END)"


_UNIT_CENTS = _half_up(_CENTS, _QTY)

STAR_CTES = f"""
w_country AS (SELECT n_name AS country, 'Earth' AS zone FROM nation),
w_product AS (SELECT CAST(p_partkey AS VARCHAR) AS stockcode, p_name AS description FROM part),
w_invoice AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS invoiceno, CAST(o_orderdate AS DATE) AS invoicedate,
         CAST(o_custkey AS DECIMAL(19,1)) AS customerid, n_name AS country
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
w_detail AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS invoiceno, CAST(l_partkey AS VARCHAR) AS stockcode,
         {_money(_UNIT_CENTS)} AS unitprice,
         CAST(l_quantity AS DECIMAL(8,0)) AS quantity,
         {_money(_CENTS)} AS totalcost
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey
                                     ORDER BY l_linenumber, l_suppkey, l_shipdate, l_extendedprice) AS rn
        FROM lineitem) WHERE rn = 1),
w_sales AS (SELECT * FROM w_detail JOIN w_invoice USING (invoiceno))"""


def with_star(body: str) -> str:
    return f"WITH {STAR_CTES}\n{body}"


def _ranking_body(dim: str, asc: bool, year: int | None) -> str:
    direction = "ASC" if asc else "DESC"
    ycol = "" if year is None else f"CAST({year} AS INTEGER) AS year, "
    where = "" if year is None else f"WHERE year(invoicedate) = {year} "
    return (
        f"SELECT {ycol}{dim}, count(*) AS n_sales FROM w_sales {where}"
        f"GROUP BY {dim} ORDER BY n_sales {direction} NULLS LAST, {dim} ASC NULLS LAST LIMIT {P.TOP_N}"
    )


def _pair_body(asc: bool, year: int | None) -> str:
    ycol = "" if year is None else "year, "
    direction = "ASC" if asc else "DESC"
    parts = []
    for tag, dim in (("country", "country"), ("product", "stockcode")):
        place = f"row_number() OVER (ORDER BY n_sales {direction}, {dim} ASC NULLS LAST)"
        parts.append(
            f"SELECT {ycol}'{tag}' AS dim, {dim} AS member, n_sales, CAST({place} AS INTEGER) AS rank "
            f"FROM ({_ranking_body(dim, asc, year)})"
        )
    return " UNION ALL ".join(parts)


def _price_sql(dtype: str = "DECIMAL(8,2)") -> str:
    return f"""SELECT p.stockcode, p.description,
       CASE WHEN n > 0 THEN {_money(_half_up('c', 'n'), dtype)} END AS mean_price
FROM w_product p JOIN (SELECT stockcode, sum(CAST(unitprice * 100 AS BIGINT)) AS c, count(unitprice) AS n
                       FROM w_detail GROUP BY stockcode) USING (stockcode)"""


def analytics_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["kpi_home"] = with_star(
        """SELECT (SELECT count(*) FROM w_invoice) AS invoices,
       (SELECT count(*) FROM w_product) AS products,
       (SELECT count(*) FROM w_country) AS countries,
       (SELECT COALESCE(CAST(trunc(sum(totalcost)) AS BIGINT), 0) FROM w_detail) AS revenue,
       (SELECT count(*) FROM w_invoice) = 0 AS is_empty"""
    )
    for label, dim in (("country", "country"), ("product", "stockcode")):
        for kind, asc in (("top", False), ("flop", True)):
            q[f"{label}_{kind}"] = with_star(_ranking_body(dim, asc, None))
            for y in P.YEARS:
                q[f"{label}_{kind}_{y}"] = with_star(_ranking_body(dim, asc, y))
    for kind, asc in (("top", False), ("flop", True)):
        q[f"pair_{kind}"] = with_star(_pair_body(asc, None))
        for y in P.YEARS:
            q[f"pair_{kind}_{y}"] = with_star(_pair_body(asc, y))
    monthly = (
        "SELECT CAST(month(invoicedate) AS INTEGER) AS month, count(*) AS n_sales, "
        "CAST(round(sum(totalcost)) AS BIGINT) AS revenue FROM w_sales GROUP BY 1"
    )
    q["monthly_sales"] = with_star(monthly + " ORDER BY 1 NULLS LAST")
    q["monthly_sales_dense"] = with_star(
        f"""SELECT CAST(m.month AS INTEGER) AS month, COALESCE(s.n_sales, 0) AS n_sales,
       COALESCE(s.revenue, 0) AS revenue
FROM range(1, 13) AS m(month) LEFT JOIN ({monthly}) s ON s.month = m.month ORDER BY 1"""
    )
    q["country_product_revenue_top"] = with_star(
        f"""SELECT stockcode, count(stockcode) AS n_lines, CAST(round(sum(totalcost)) AS BIGINT) AS revenue
FROM w_sales WHERE country = '{P.DRILL_COUNTRY}' GROUP BY stockcode
ORDER BY revenue DESC NULLS LAST, stockcode ASC NULLS LAST LIMIT {P.TOP_N}"""
    )
    price = _price_sql()
    q["product_price_list"] = with_star(price + " ORDER BY stockcode")
    t = P.SEARCH_TERM.lower()
    q["product_price_search"] = with_star(
        f"""SELECT * FROM ({price}) WHERE lower(description) LIKE '%{t}%' OR lower(stockcode) LIKE '%{t}%'
   OR CAST(mean_price AS VARCHAR) LIKE '%{t}%'
ORDER BY stockcode LIMIT {P.SEARCH_PAGE} OFFSET {P.SEARCH_OFFSET}"""
    )
    q["product_price_search_by_price"] = with_star(
        f"""SELECT * FROM ({price}) WHERE lower(description) LIKE '%{P.SEARCH_PRICE}%' OR lower(stockcode) LIKE '%{P.SEARCH_PRICE}%'
   OR CAST(mean_price AS VARCHAR) LIKE '%{P.SEARCH_PRICE}%'
ORDER BY mean_price DESC NULLS LAST, stockcode LIMIT {P.SEARCH_PAGE}"""
    )
    words = " AND ".join(
        f"(lower(description) LIKE '%{w}%' OR lower(stockcode) LIKE '%{w}%' OR CAST(mean_price AS VARCHAR) LIKE '%{w}%')"
        for w in ("1", "ring", "hot r")
    )
    q["product_price_search_words"] = with_star(f"SELECT * FROM ({price}) WHERE {words} ORDER BY stockcode LIMIT {P.SEARCH_PAGE}")
    q["region_product_top3"] = with_star(
        f"""SELECT country, stockcode, n_sales, CAST(rnk AS INTEGER) AS rank FROM (
  SELECT country, stockcode, count(*) AS n_sales,
         row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, stockcode ASC NULLS LAST) AS rnk
  FROM w_sales GROUP BY country, stockcode) WHERE rnk <= {P.JOINT_TOP_K}"""
    )
    return q




# ---------------------------------------------------------------------------
# Dirty export, cleaning and merge
# ---------------------------------------------------------------------------

RAW = "invoiceno, stockcode, description, quantity, invoicedate, unitprice, customerid, country"
ORDER_BY = "copy, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
PLACEHOLDER = "Description du produit à intégrer"

DIRTY_CTES = f"""
d_base AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS invoiceno,
         CASE WHEN l_partkey % 97 = 0 THEN 'P' ELSE '' END || CAST(l_partkey AS VARCHAR) AS stockcode,
         CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE p_name END AS description,
         CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1
                   THEN -l_quantity ELSE l_quantity END AS DECIMAL(8,0)) AS quantity,
         CAST(o_orderdate AS DATE) AS invoicedate,
         CASE WHEN (l_orderkey + l_partkey) % 101 = 0 THEN CAST(0 AS DECIMAL(18,6))
              ELSE {_money(_UNIT_CENTS, 'DECIMAL(18,6)')} END AS unitprice,
         CAST(CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS DECIMAL(19,1)) AS customerid,
         upper(n_name) AS country,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
dirty AS (SELECT 0 AS copy, * FROM d_base UNION ALL SELECT 1 AS copy, * FROM d_base WHERE l_orderkey % 50 = 0),
batch_a AS (SELECT * FROM dirty WHERE l_orderkey % 3 <> 0),
batch_b AS (SELECT * REPLACE (invoicedate + 30 AS invoicedate) FROM dirty WHERE l_orderkey % 3 <> 1),
strained AS (SELECT * REPLACE (
    CASE WHEN l_orderkey % 61 = 0 THEN NULL WHEN l_orderkey % 67 = 0 THEN invoiceno || '00000000' ELSE invoiceno END AS invoiceno,
    CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE stockcode END AS stockcode,
    CASE WHEN l_partkey % 71 = 0 THEN repeat(description, 12) ELSE description END AS description,
    CASE WHEN l_linenumber = 5 AND l_orderkey % 3 = 0 THEN NULL ELSE quantity END AS quantity,
    CAST(CASE WHEN l_partkey % 79 = 0 THEN unitprice * 10000 WHEN l_partkey % 83 = 0 THEN unitprice + 0.005
         ELSE unitprice END AS DECIMAL(18,6)) AS unitprice,
    CASE WHEN l_orderkey % 59 = 0 THEN NULL WHEN l_orderkey % 73 = 0 THEN '12.5' ELSE country END AS country) FROM dirty),
written AS (SELECT * REPLACE (
    CASE WHEN l_partkey % 107 = 0 THEN 0.4 WHEN l_partkey % 103 = 0 THEN quantity + 0.4 ELSE quantity END::DECIMAL(16,6) AS quantity,
    CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE invoicedate::TIMESTAMP + to_hours(((l_orderkey
         + CASE WHEN l_orderkey % 100 = 0 THEN copy ELSE 0 END) % 24)::INTEGER) END AS invoicedate,
    CASE WHEN (l_orderkey + l_partkey) % 109 = 0 THEN 0.0000004::DECIMAL(21,10) ELSE unitprice::DECIMAL(21,10) END AS unitprice),
    CASE WHEN l_orderkey % 211 = 0 THEN 1 ELSE 0 END AS bad FROM dirty)"""


def _title(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '([A-Za-z]+|[^A-Za-z]+)'), "
        f"lambda t: upper(t[1]) || lower(t[2:])), '')"
    )


_LE0 = "coalesce({c} <= 0, false)"
_LETTER = "coalesce(regexp_matches(stockcode, '^[A-Za-z]'), false)"


def _clean(src: str, mode: str = "intended", cost: str = "CAST(unitprice * quantity AS DECIMAL(27,6))") -> str:
    """Cleaned rows of ``src`` (C01-C10), lineage columns kept."""
    country = _title("country")
    description = "description"
    if mode == "intended":
        country = (
            f"CASE WHEN country IS NULL OR regexp_matches(country, '^[0-9.]+$') THEN 'Unspecified' "
            f"ELSE {country} END"
        )
        description = f"coalesce(description, '{PLACEHOLDER}')"
    return f"""(SELECT * REPLACE ({country} AS country, {description} AS description),
        {cost} AS totalcost
 FROM (SELECT *, row_number() OVER (PARTITION BY invoiceno, stockcode ORDER BY {ORDER_BY}) AS rn_key FROM {src})
 WHERE rn_key = 1 AND NOT {_LE0.format(c='quantity')} AND NOT {_LE0.format(c='unitprice')} AND NOT {_LETTER})"""


CLEAN_OUT = RAW + ", totalcost"


def with_dirty(body: str, star: bool = False) -> str:
    ctes = DIRTY_CTES + ("," + STAR_CTES if star else "")
    return f"WITH {ctes}\n{body}"


def _merged(table: str) -> str:
    """Rows of one star table after merging clean(batch A) then clean(batch B)."""
    return with_dirty(f", {_both_batches()}\n{_merged_body(table)}")


def _both_batches() -> str:
    return f"""merged AS (SELECT 0 AS batch, * FROM {_clean('batch_a')}
                UNION ALL SELECT 1 AS batch, * FROM {_clean('batch_b')})"""


def _merged_body(table: str) -> str:
    first = "row_number() OVER (PARTITION BY {k} ORDER BY batch, " + ORDER_BY + ") AS rn_first"
    if table == "country":
        body = "SELECT DISTINCT country, 'Earth' AS zone FROM merged"
    elif table == "product":
        body = f"SELECT stockcode, description FROM (SELECT *, {first.format(k='stockcode')} FROM merged) WHERE rn_first = 1"
    elif table == "invoice":
        body = (
            f"SELECT invoiceno, invoicedate, customerid, country FROM "
            f"(SELECT *, {first.format(k='invoiceno')} FROM merged) WHERE rn_first = 1"
        )
    else:
        body = (
            "SELECT invoiceno, stockcode, CAST(unitprice AS DECIMAL(18,2)) AS unitprice, "
            "CAST(quantity AS DECIMAL(18,0)) AS quantity, CAST(totalcost AS DECIMAL(28,2)) AS totalcost FROM "
            f"(SELECT *, {first.format(k='invoiceno, stockcode')} FROM merged) WHERE rn_first = 1"
        )
    return body


def _loaded(body: str) -> str:
    """A query over the star that both batches make."""
    names = {"country": "country", "product": "product", "invoice": "invoice", "detailinvoice": "detail"}
    tables = ", ".join(f"w_{w} AS ({_merged_body(t)})" for t, w in names.items())
    return with_dirty(f", {_both_batches()}, {tables}, w_sales AS (SELECT * FROM w_detail JOIN w_invoice USING (invoiceno))\n{body}")


def _report(src: str, distinct: str) -> str:
    return f"""SELECT n_rows, n_dup, n_dup_key, n_qty_le0, n_price_le0, n_letter_code, to_delete,
       n_rows AS n_country_cells, n_null_cells, n_rows + n_null_cells AS to_repair,
       n_rows - to_delete AS remaining,
       CASE WHEN n_rows > 0 THEN round(to_delete / n_rows * 100, 2) END AS pct_deleted,
       CASE WHEN n_rows > 0 AND round(to_delete / n_rows * 100, 2) <= 5 THEN 'clean' ELSE 'not_advised' END AS advice
FROM (SELECT *, n_dup + n_qty_le0 + n_price_le0 + n_letter_code AS to_delete FROM (
  SELECT count(*) AS n_rows,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT {distinct} FROM {src})) AS n_dup,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT invoiceno, stockcode FROM {src})) AS n_dup_key,
         count(*) FILTER (WHERE quantity <= 0) AS n_qty_le0,
         count(*) FILTER (WHERE unitprice <= 0) AS n_price_le0,
         count(*) FILTER (WHERE regexp_matches(stockcode, '^[A-Za-z]')) AS n_letter_code,
         CAST(count(*) FILTER (WHERE invoiceno IS NULL) + count(*) FILTER (WHERE stockcode IS NULL)
            + count(*) FILTER (WHERE description IS NULL) + count(*) FILTER (WHERE quantity IS NULL)
            + count(*) FILTER (WHERE invoicedate IS NULL AND {"bad = 0" if "bad" in distinct else "true"})
            + count(*) FILTER (WHERE unitprice IS NULL)
            + count(*) FILTER (WHERE customerid IS NULL) + count(*) FILTER (WHERE country IS NULL) AS BIGINT)
           AS n_null_cells
  FROM {src}))"""


def etl_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["quality_report"] = with_dirty(_report("dirty", RAW))
    labels = "('duplicate_row'), ('duplicate_key'), ('quantity_le0'), ('price_le0'), ('letter_code'), ('kept')"
    q["quality_by_rule"] = with_dirty(
        f""", cls AS (
  SELECT CASE WHEN rn_full > 1 THEN 'duplicate_row'
              WHEN rn_key > 1 THEN 'duplicate_key'
              WHEN {_LE0.format(c='quantity')} THEN 'quantity_le0'
              WHEN {_LE0.format(c='unitprice')} THEN 'price_le0'
              WHEN {_LETTER} THEN 'letter_code'
              ELSE 'kept' END AS rejected_by
  FROM (SELECT *, row_number() OVER (PARTITION BY {RAW} ORDER BY {ORDER_BY}) AS rn_full,
                  row_number() OVER (PARTITION BY invoiceno, stockcode ORDER BY {ORDER_BY}) AS rn_key
        FROM dirty))
SELECT l.rejected_by, CAST(count(c.rejected_by) AS BIGINT) AS n_rows
FROM (VALUES {labels}) AS l(rejected_by) LEFT JOIN cls c ON c.rejected_by = l.rejected_by
GROUP BY l.rejected_by"""
    )
    q["clean_rows"] = with_dirty(f"SELECT {CLEAN_OUT} FROM {_clean('dirty')}")
    q["clean_rows_as_written"] = with_dirty(f"SELECT {CLEAN_OUT} FROM {_clean('dirty', 'as_written')}")
    q["rejected_rows"] = with_dirty(
        f"""SELECT {RAW}, rejected_by FROM (
  SELECT *, CASE WHEN rn_full > 1 THEN 'duplicate_row'
                 WHEN rn_key > 1 THEN 'duplicate_key'
                 WHEN {_LE0.format(c='quantity')} THEN 'quantity_le0'
                 WHEN {_LE0.format(c='unitprice')} THEN 'price_le0'
                 WHEN {_LETTER} THEN 'letter_code' END AS rejected_by
  FROM (SELECT *, row_number() OVER (PARTITION BY {RAW} ORDER BY {ORDER_BY}) AS rn_full,
                  row_number() OVER (PARTITION BY invoiceno, stockcode ORDER BY {ORDER_BY}) AS rn_key
        FROM dirty)) WHERE rejected_by IS NOT NULL"""
    )
    q["clean_country_title"] = with_dirty(
        f"SELECT country AS country_raw, count(*) AS n_rows, {_title('country')} AS country FROM dirty GROUP BY country"
    )
    q["clean_fill_missing"] = with_dirty(
        f"""SELECT invoiceno, stockcode, description, country FROM {_clean('strained')}
WHERE description = '{PLACEHOLDER}' OR country = 'Unspecified'"""
    )

    def report(check: str, flags: dict[str, str], src: str = "strained") -> str:
        parts = [
            f"SELECT '{check}' AS \"check\", '{c}' AS \"column\", count(*) AS n_rows, "
            f"CAST(count(*) FILTER (WHERE {f}) AS BIGINT) AS n_violations FROM {src}"
            for c, f in flags.items()
        ]
        return " UNION ALL ".join(parts)

    q["constraint_not_null"] = with_dirty(
        report("not_null", {c: f"{c} IS NULL" for c in ("invoiceno", "stockcode", "country", "quantity")})
    )
    q["constraint_length"] = with_dirty(
        report("max_length", {c: f"length({c}) > {n}" for c, n in
                              (("invoiceno", 7), ("stockcode", 50), ("description", 80), ("country", 50))})
    )
    rng = {
        "unitprice": "unitprice IS NOT NULL AND abs(unitprice) >= 999999.995",
        "quantity": "quantity IS NOT NULL AND abs(quantity) >= 99999999.5",
        "totalcost": "totalcost IS NOT NULL AND abs(totalcost) >= 999999.995",
        "customerid": "customerid IS NOT NULL AND abs(customerid) >= 9999999.95",
    }
    q["constraint_decimal_range"] = with_dirty(
        ", dirty_cost AS (SELECT *, unitprice * quantity AS totalcost FROM strained)\n"
        + report("decimal_range", rng, "dirty_cost")
    )
    uniq = [
        ("export", "invoiceno,stockcode", "dirty", "invoiceno, stockcode"),
        ("country", "country", "w_country", "country"),
        ("product", "stockcode", "w_product", "stockcode"),
        ("invoice", "invoiceno", "w_invoice", "invoiceno"),
        ("detailinvoice", "invoiceno,stockcode", "w_detail", "invoiceno, stockcode"),
    ]
    q["constraint_unique"] = with_dirty(
        " UNION ALL ".join(
            f"""SELECT '{t}' AS "table", '{label}' AS "key", count(*) AS n_keys,
       count(*) FILTER (WHERE c > 1) AS n_dup_keys, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_dup_rows
FROM (SELECT {cols}, count(*) AS c FROM {src} GROUP BY {cols})"""
            for t, label, src, cols in uniq
        ),
        star=True,
    )
    q["constraint_orphans"] = with_star(
        """SELECT 'detailinvoice->invoice' AS relation, count(*) AS n_orphans FROM w_detail d
  WHERE d.invoiceno IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM w_invoice i WHERE i.invoiceno = d.invoiceno AND NOT ends_with(i.invoiceno, '7'))
UNION ALL
SELECT 'detailinvoice->product', count(*) FROM w_detail d
  WHERE d.stockcode IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM w_product p WHERE p.stockcode = d.stockcode AND NOT ends_with(p.stockcode, '3'))
UNION ALL
SELECT 'invoice->country', count(*) FROM w_invoice i
  WHERE i.country IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM w_country c WHERE c.country = i.country AND NOT ends_with(c.country, '4'))"""
    )
    q["constraint_dates"] = with_dirty(
        """, txt AS (SELECT CASE WHEN l_orderkey % 13 = 0 THEN strftime(invoicedate, '%Y-%m-%d')
                    ELSE strftime(invoicedate, '%-m/%-d/%Y %-H:%M') END AS invoicedate FROM dirty)
SELECT 'date_parse' AS "check", 'invoicedate' AS "column", count(*) AS n_rows,
       CAST(count(*) FILTER (WHERE invoicedate IS NOT NULL
            AND try_strptime(invoicedate, '%m/%d/%Y %H:%M') IS NULL) AS BIGINT) AS n_violations,
       'default' AS formats FROM txt
UNION ALL
SELECT 'date_parse', 'invoicedate', count(*),
       CAST(count(*) FILTER (WHERE invoicedate IS NOT NULL AND try_strptime(invoicedate, '%m/%d/%Y %H:%M') IS NULL
            AND try_strptime(invoicedate, '%Y-%m-%d') IS NULL) AS BIGINT),
       'default+iso' FROM txt"""
    )
    for name, key in (("country", "load_country"), ("product", "load_product"),
                      ("invoice", "load_invoice"), ("detailinvoice", "load_detail")):
        q[key] = _merged(name)
    q["stream_ingest"] = q["load_detail"]
    q["landing_incremental"] = q["load_detail"]
    clean_a = _clean("dirty")
    q["load_twice_is_noop"] = with_dirty(
        f""", ca AS (SELECT * FROM {clean_a})
SELECT 'country' AS "table", count(DISTINCT country) AS n_rows FROM ca
UNION ALL SELECT 'product', count(DISTINCT stockcode) FROM ca
UNION ALL SELECT 'invoice', count(DISTINCT invoiceno) FROM ca
UNION ALL SELECT 'detailinvoice', count(*) FROM ca"""
    )
    q["warehouse_reset"] = with_dirty(
        f"""SELECT invoiceno, stockcode, CAST(unitprice AS DECIMAL(18,2)) AS unitprice, CAST(quantity AS DECIMAL(18,0)) AS quantity,
       CAST(totalcost AS DECIMAL(28,2)) AS totalcost FROM {_clean('batch_b')}"""
    )
    q["landing_mixed_headers"] = q["load_detail"]
    q["stream_mixed_headers"] = q["load_detail"]
    q["load_long_numbers"] = with_dirty(
        f"""SELECT invoiceno || '00000000' AS invoiceno, invoicedate, customerid, country FROM (
  SELECT *, row_number() OVER (PARTITION BY invoiceno ORDER BY {ORDER_BY}) AS rn_first FROM {_clean('dirty')}) WHERE rn_first = 1"""
    )
    breaks = [(f"{c} IS NULL", f"not_null:{c}") for c in ("invoiceno", "stockcode", "country", "quantity")]
    breaks += [(f"length({c}) > {n}", f"max_length:{c}") for c, n in
               (("invoiceno", 7), ("stockcode", 50), ("description", 80), ("country", 50))]
    breaks += [(f, f"decimal_range:{c}") for c, f in rng.items()]
    label = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for f, name in breaks) + " END"
    q["load_rejected"] = with_dirty(
        f"""SELECT {RAW}, rejected_by FROM (
  SELECT *, CASE WHEN rn_full > 1 THEN 'duplicate_row'
                 WHEN rn_key > 1 THEN 'duplicate_key'
                 WHEN {_LE0.format(c='quantity')} THEN 'quantity_le0'
                 WHEN {_LE0.format(c='unitprice')} THEN 'price_le0'
                 WHEN {_LETTER} THEN 'letter_code' END AS rejected_by
  FROM (SELECT *, row_number() OVER (PARTITION BY {RAW} ORDER BY {ORDER_BY}) AS rn_full,
                  row_number() OVER (PARTITION BY invoiceno, stockcode ORDER BY {ORDER_BY}) AS rn_key
        FROM strained)) WHERE rejected_by IS NOT NULL
UNION ALL
SELECT {RAW}, rejected_by FROM (SELECT *, {label} AS rejected_by FROM {_clean('strained')}) WHERE rejected_by IS NOT NULL"""
    )
    q["quality_report_csv"] = with_dirty(_report("written", RAW + ", bad"))
    q["quality_report_clean"] = with_dirty(f", cleaned AS (SELECT * FROM {_clean('dirty')})\n" + _report("cleaned", RAW))
    q["clean_rows_csv"] = with_dirty(f"SELECT {CLEAN_OUT} FROM {_clean('written', cost='CAST(unitprice * quantity AS DECIMAL(28,8))')}")
    q["warehouse_country_top"] = _loaded(
        f"SELECT country, count(*) AS n_sales FROM w_sales GROUP BY country ORDER BY n_sales DESC, country ASC NULLS LAST LIMIT {P.TOP_N}"
    )
    q["warehouse_monthly"] = _loaded(
        "SELECT CAST(month(invoicedate) AS INTEGER) AS month, count(*) AS n_sales, "
        "CAST(round(sum(totalcost)) AS BIGINT) AS revenue FROM w_sales GROUP BY 1 ORDER BY 1 NULLS LAST"
    )
    q["warehouse_price_list"] = _loaded(_price_sql("DECIMAL(8,2)") + " ORDER BY stockcode")
    one = "merged AS (SELECT 0 AS batch, * FROM {})"
    q["load_interleaved"] = with_dirty(f", {one.format(_clean('dirty'))}\n{_merged_body('detailinvoice')}")
    q["load_compacted"] = _merged("detailinvoice")
    q["load_zone_restamp"] = with_dirty(
        f""", {_both_batches()}, zones AS (
  SELECT {_title('n_name')} AS name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0)
SELECT DISTINCT country, coalesce(r_name, 'Earth') AS zone FROM merged LEFT JOIN zones ON name = country"""
    )
    q["load_surrogate"] = with_dirty(
        f""", {_both_batches()}, fact AS ({_merged_body('detailinvoice')})
SELECT count(*) AS n_rows, count(*) AS n_ids, 1::BIGINT AS first_id, count(*) AS last_id, 0::BIGINT AS n_late_among_first,
       (SELECT count(*) FROM merged WHERE batch = 0) AS n_first FROM fact"""
    )
    rich = "rich AS (SELECT * REPLACE (CAST(unitprice * 100000 AS DECIMAL(18,6)) AS unitprice) FROM batch_a)"
    q["warehouse_price_list_wide"] = with_dirty(
        f", {rich}, {one.format(_clean('rich'))}, w_product AS ({_merged_body('product')}), w_detail AS ({_merged_body('detailinvoice')})\n"
        + _price_sql("DECIMAL(18,2)") + " ORDER BY stockcode"
    )
    q["warehouse_kpi"] = _loaded(
        """SELECT (SELECT count(*) FROM w_invoice) AS invoices, (SELECT count(*) FROM w_product) AS products,
       (SELECT count(*) FROM w_country) AS countries,
       (SELECT COALESCE(CAST(trunc(sum(totalcost)) AS BIGINT), 0) FROM w_detail) AS revenue,
       (SELECT count(*) FROM w_invoice) = 0 AS is_empty"""
    )
    q["warehouse_product_top"] = _loaded(
        f"SELECT stockcode, count(*) AS n_sales FROM w_sales GROUP BY stockcode ORDER BY n_sales DESC, stockcode ASC NULLS LAST LIMIT {P.TOP_N}"
    )
    q["csv_escapes"] = with_dirty(
        r"""SELECT invoiceno, stockcode, description || CASE l_partkey % 5 WHEN 0 THEN 'Aé' WHEN 1 THEN '\n'
         WHEN 2 THEN 'A' || chr(9) || 'b' WHEN 3 THEN 'c:\q' ELSE 'plain' END AS description FROM dirty"""
    )
    q["stage_replace"] = with_dirty(f"SELECT {CLEAN_OUT} FROM {_clean('batch_b')}")
    q["csv_round_trip"] = with_dirty(f"SELECT {RAW}, 0 AS n_unparsed FROM dirty")
    q["csv_header_any_case"] = q["clean_rows"]
    return q


def oracle_sql() -> dict[str, str]:
    out = analytics_sql()
    out.update(etl_sql())
    return out
