"""An access log derived from the events table, by one set of SQL expressions that Spark and DuckDB share.

Only the reading of time differs between the two; everything else is integer arithmetic and literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENTS = [
    "Mozilla/5.0%20(Macintosh;%20Intel%20Mac%20OS%20X%2014_5)%20AppleWebKit/605.1.15%20Version/17.5%20Safari/605.1.15",
    "Mozilla/5.0%20(Windows%20NT%2010.0)%20AppleWebKit/537.36%20Chrome/126.0%20Safari/537.36",
    "Mozilla/5.0%20(Windows%20NT%2010.0)%20AppleWebKit/537.36%20Chrome/126.0%20Safari/537.36%20Edg/126.0",
    "Mozilla/5.0%20(iPhone;%20CPU%20iPhone%20OS%2017_5)%20AppleWebKit/605.1.15%20CriOS/126.0%20Mobile/15E148%20Safari/604.1",
    "Mozilla/5.0%20(Linux;%20Android%2014)%20AppleWebKit/537.36%20SamsungBrowser/25.0%20Chrome/121.0%20Mobile%20Safari/537.36",
    "Mozilla/5.0%20(Android%2014;%20rv:127.0)%20Gecko/127.0%20Firefox/127.0",
    "Mozilla/5.0%20(compatible;%20ExampleBot/2.1;%20+http://bot.example/)",
    "Opera/9.80%20(J2ME/MIDP;%20Opera%20Mini/7.1)%20Presto/2.12",
    "Mozilla/5.0%20(iPad;%20CPU%20OS%2017_5)%20AppleWebKit/605.1.15%20Version/17.5%20Safari/605.1.15",
    "fetcher/1.0",
]
PAGES = ["/", "/words/", "/words/caf%25C3%25A9/", "/blog/", "/blog/a%2520b/", "/about/"]
REFERERS = ["-", "https://www.example.com/", "https://search.example.net/?q=x", "https://news.example.org/a", "http://[bad", "https://social.example.io/"]
VITAL_NAMES = ["lcp", "cls", "fcp", "ttfb"]


def _pick(number: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


def columns(ms: str, year: str, month: str, day: str, hour: str) -> dict[str, str]:
    """Expressions over events; the arguments say how an engine reads its time."""
    e, u, kind = "event_id", "user_id", "event_type"
    purchase_beacon = f"({kind} = 'purchase' AND {e} % 2 = 0)"
    checkout = f"({kind} = 'purchase' AND {e} % 2 = 1)"
    beacon = f"({purchase_beacon} OR {kind} = 'error')"
    asset = f"CASE WHEN {u} % 3 = 0 THEN '/img/photo.png' ELSE {_pick(e, ['/a/site.css', '/a/app.js', '/a/font.woff2', '/img/photo.png'])} END"
    value = f"CAST(({e} * 37) % 5000 AS STRING)"
    page = "%25252Fwords%25252F"
    vital = f"{_pick(e, VITAL_NAMES)}"
    v2_vital = f"'v=2&b=' || {vital} || '%252C{page}%252C' || {value}"
    v2_two = f"{v2_vital} || '%253B' || 'route%252C%25252Fblog%25252F' || '%253B' || 'lcp%252C{page}%252C12x'"
    v1_error = f"'v=1&e=' || CASE WHEN {e} % 3 = 0 THEN 'rejection' ELSE 'error' END || '&p=%252Fwords%252F&m=a%252Cb%253Bc%2520' || CAST({u} % 5 AS STRING)"
    v2_error = f"'v=2&b=error%252C%25252F%252C%252C%252Cbad%252520thing%25252C' || CAST({u} % 3 AS STRING)"
    refund = f"CASE WHEN {e} % 26 = 0 THEN '-' ELSE '' END"
    purchase = f"'v=2&b=purchase%252C%25252Fdo%25252F%252C' || {refund} || {value}"
    error_query = f"CASE {e} % 4 WHEN 0 THEN {v1_error} WHEN 1 THEN {v2_vital} WHEN 2 THEN {v2_error} ELSE {v2_two} END"
    search = f"'q=' || {_pick(e, ['apple', 'red%2520pear', 'caf%25C3%25A9', 'plum%252Bfig', ''])} || '&x=' || CAST({e} % 2 AS STRING)"
    return {
        "timestamp_ms": f"CAST({ms} AS STRING)",
        "c_ip": f"CASE WHEN {e} % 101 = 0 THEN NULL WHEN {e} % 97 = 0 THEN '-' ELSE '203.0.113.' || CAST({u} % 250 AS STRING) END",
        "cs_user_agent": f"CASE WHEN {e} % 103 = 0 THEN NULL ELSE {_pick(u, AGENTS)} END",
        "x_host_header": f"CASE WHEN {e} % 5 = 0 THEN 'blog.example.com' ELSE 'www.example.com' END",
        "c_country": _pick(u, ["GB", "US", "DE", "FR"]),
        "distributionid": f"CASE WHEN {e} % 10 = 0 THEN 'D2' ELSE 'D1' END",
        "cs_method": f"CASE WHEN {checkout} THEN 'POST' ELSE 'GET' END",
        "cs_uri_stem": f"CASE WHEN {beacon} THEN '/_beacon' WHEN {checkout} THEN '/do/checkout' WHEN {kind} = 'click' THEN {asset} WHEN {kind} = 'signup' THEN {_pick(e, ['/search/', '/words/search/'])} ELSE {_pick(e, PAGES)} END",
        "cs_uri_query": f"CASE WHEN {purchase_beacon} THEN {purchase} WHEN {kind} = 'error' THEN {error_query} WHEN {kind} = 'signup' THEN {search} ELSE '-' END",
        "sc_status": f"CASE WHEN {beacon} THEN '204' WHEN {checkout} THEN CASE WHEN {e} % 3 = 0 THEN '400' ELSE '303' END WHEN {kind} = 'signup' THEN {_pick(e, ['200', '302', '308'])} WHEN {e} % 7 = 0 THEN '304' WHEN {e} % 11 = 0 THEN '404' ELSE '200' END",
        "sc_content_type": f"CASE WHEN {beacon} OR {checkout} THEN '-' WHEN {kind} = 'click' THEN 'text/css' ELSE 'text/html; charset=utf-8' END",
        "cs_referer": _pick(e, REFERERS),
        "x_edge_result_type": _pick(e, ["Hit", "RefreshHit", "Miss", "Error", "FunctionGeneratedResponse"]),
        "ts_ms": ms,
        "year": year,
        "month": month,
        "day": day,
        "hour": hour,
    }


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a folder of test tables."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    part = lambda form: f"date_format(ts, '{form}')"
    own = columns("unix_millis(ts)", part("yyyy"), part("MM"), part("dd"), part("HH"))
    return rows.select(*[F.expr(x).alias(n) for n, x in own.items()])


def flooded(log: DataFrame, times: int = 90) -> DataFrame:
    """The log with the beacon rows of a few senders repeated, a millisecond apart, past every hourly cap."""
    chosen = (F.col("cs_uri_stem") == "/_beacon") & (F.col("ts_ms") % 50 == 0)
    n = F.when(chosen, F.lit(times)).otherwise(1)
    rows = log.withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    rows = rows.withColumn("ts_ms", F.col("ts_ms") - F.col("ts_ms") % 3_600_000 + F.col("k") + (F.col("ts_ms") % 1000))
    return rows.withColumn("timestamp_ms", F.col("ts_ms").cast("string")).drop("k")


def _duck() -> str:
    part = lambda form: f"strftime(ts, '{form}')"
    own = columns("(epoch_us(ts) // 1000)", part("%Y"), part("%m"), part("%d"), part("%H"))
    return ", ".join(f"{x} AS {n}" for n, x in own.items())


#: Common table expressions for DuckDB: log, with the decoded path.
DUCK_LOG = f"""log AS (
  SELECT *, url_decode(replace(url_decode(replace(cs_uri_stem, '+', ' ')), '+', ' ')) AS path
  FROM (SELECT {_duck()} FROM events)
)"""
DUCK_FLOODED = """log AS (
  SELECT * EXCLUDE (ts_ms, timestamp_ms, k, moved), moved AS ts_ms, CAST(moved AS STRING) AS timestamp_ms
  FROM (SELECT *, ts_ms - ts_ms % 3600000 + k + ts_ms % 1000 AS moved FROM (
    SELECT *, unnest(range(1, CASE WHEN cs_uri_stem = '/_beacon' AND ts_ms % 50 = 0 THEN 91 ELSE 2 END)) AS k FROM plain_log))
)"""
