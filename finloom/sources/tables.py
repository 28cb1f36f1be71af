"""Transaction, party, statement and fragment views over the driver's tables.

The projections are SQL text in the dialect that Spark and the test engine share,
so that both see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finloom.cluster import ship

#: Narratives by remainder of the order key: (text, side).
PHRASES = (
    ("EPF DPE CONTRIBUTION", "DR"), ("KWSP CARUMAN", "DR"), ("PERKESO CONTRIBUTION", "DR"), ("EIS PAYMENT", "DR"),
    ("LEMBAGA HASIL DALAM NEGERI CP204", "DR"), ("LHDN PCB", "DR"), ("PEMBANGUNAN SUMBER MANUSIA", "DR"), ("HRDF LEVY", "DR"),
    ("SALARY JAN", "DR"), ("PAYROLL BATCH", "DR"), ("GAJI BULANAN", "DR"), ("SALARY COMMISSION", "DR"),
    ("RETURNED CHQ 00123", "DR"), ("CHQ RETURN OUTWARD", "CR"), ("IBG INWARD RETURN", "CR"), ("REVERSAL OF CHARGE", "CR"),
    ("CDM CASH DEPOSIT", "CR"), ("CASH CHQ DR 991", "DR"), ("HSE CHQ DEPOSIT", "CR"), ("CLRG CHQ DR 881", "DR"),
    ("SERVICE TAX 6%", "DR"), ("STAMP DUTY", "DR"), ("TERM LOAN INSTALMENT", "DR"), ("HIRE PURCHASE PYMT", "DR"),
    ("LOAN DISBURSEMENT", "CR"), ("INVOICE FIN PROCEEDS", "CR"), ("DUITNOW TRANSFER ALPHA MAJU SDN BHD", "DR"), ("IBG PAYMENT DELTA TRADING", "DR"),
    ("IBG CREDIT OMEGA HOLDINGS", "CR"), ("TRANSFER FROM BINTANG JAYA", "CR"), ("TRANSFER TO BINTANG JAYA", "DR"), ("ADVANCE TO RAHIM BIN OSMAN", "DR"),
    ("SWIFT INWARD USD 1,200", "CR"), ("FX CONVERSION", "DR"), ("RENTAS USD SETTLEMENT", "DR"), ("OPENING BALANCE", "CR"),
    ("GIRO PAYMENT", "DR"), ("INTERBANK TRANSFER", "CR"), ("JOMPAY 12345", "DR"), ("MISC ITEM", "CR"),
)

#: Printed names of counterparties by remainder of the customer key.
NAMES = (
    "ALPHA MAJU SDN BHD", "ALPHA MAJU SDN BH", "DELTA TRADING", "OMEGA HOLDINGS", "RAHIM BIN OSMAN", "SITI BINTI ALI",
    "CASH DEPOSIT", "TRANSFER FR A/C", "BINTANG JAYA SDN BHD", "PELITA CREDIT LEASING", "KOPERASI WARIS BERHAD", "(M) 010 GAMMA SB",
)
COMPANY = "BINTANG JAYA SDN BHD"
RELATED = ("RAHIM BIN OSMAN",)
FACTORS = ("OMEGA HOLDINGS",)


def _case(key: str, values) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: One row per event: account, row_ord, date, month, debit and credit in cents.
EVENTS_SQL = """
SELECT user_id AS account, event_id AS row_ord, CAST(ts AS DATE) AS date, substr(CAST(ts AS STRING), 1, 7) AS month,
       CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS credit,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS debit,
       event_type AS kind, ts
FROM events
"""

#: One row per order, with a narrative and a counterparty.
LEDGER_SQL = f"""
SELECT account, row_ord, date, month, description, counterparty, bank,
       CASE WHEN side = 'CR' THEN amount ELSE 0 END AS credit, CASE WHEN side = 'DR' THEN amount ELSE 0 END AS debit
FROM (
  SELECT o_custkey % 40 AS account, o_orderkey AS row_ord, CAST(o_orderdate AS DATE) AS date,
         substr(CAST(o_orderdate AS STRING), 1, 7) AS month,
         {_case("o_orderkey", [p for p, _ in PHRASES])} || ' ' || o_orderpriority AS description,
         {_case("o_orderkey", [s for _, s in PHRASES])} AS side,
         {_case("o_custkey", NAMES)} AS counterparty,
         {_case("o_custkey", ["NORTH BANK", "SOUTH BANK", "EAST BANK"])} AS bank,
         CASE WHEN o_orderkey % 11 = 0 THEN CAST(floor(o_totalprice / 10000) AS BIGINT) * 1000000
              ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS amount
  FROM orders
) o
"""

#: Yearly statement figures from line items, in cents.
FIGURES_SQL = """
SELECT substr(CAST(l_shipdate AS STRING), 1, 4) AS period, l_suppkey % 25 AS entity,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue,
       CAST(sum(CAST(round(l_extendedprice * 60) AS BIGINT)) AS BIGINT) AS cost,
       CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS expenses,
       CAST(sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
       CAST(sum(CAST(l_quantity AS BIGINT)) * 100 AS BIGINT) AS interest,
       CAST(count(*) AS BIGINT) AS line_count
FROM lineitem GROUP BY 1, 2
"""

#: Lines of documents as page fragments: ten lines a page, every seventh a header.
FRAGMENTS_SQL = {
    "spark": """
SELECT doc_id, CAST(floor(pos / 10) AS INT) + 1 AS page, CAST(pos AS INT) AS reading_order,
       CASE WHEN pos % 7 = 0 THEN 'section_header' WHEN pos % 7 = 3 THEN 'table' ELSE 'text' END AS kind, line AS content
FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM documents)
""",
    "duck": """
SELECT doc_id, CAST(floor(pos / 10) AS INT) + 1 AS page, CAST(pos AS INT) AS reading_order,
       CASE WHEN pos % 7 = 0 THEN 'section_header' WHEN pos % 7 = 3 THEN 'table' ELSE 'text' END AS kind, line AS content
FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; functions that run in Python workers find this package from then on."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a part that a task sorts.
PART_ROWS = 500_000


def parted(df: DataFrame, key: str, rows: int = PART_ROWS) -> DataFrame:
    """``df`` by a hash of the key, in as many parts as its rows ask for, so that a task's share doesn't grow with the table."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(parts, key)


def _view(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    return spark.sql(text.replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", EVENTS_SQL)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", LEDGER_SQL)


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", FIGURES_SQL)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "documents", FRAGMENTS_SQL["spark"])
