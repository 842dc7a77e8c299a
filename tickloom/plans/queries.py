"""Registered queries over the shared test tables and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.numeric import coerce
from tickloom.functions.symbols import of_roots, parse_symbol
from tickloom.functions.times import clock_columns, in_session
from tickloom.operators import clean, features, metrics, models, rolling, select
from tickloom.operators.direction import add_direction
from tickloom.operators.labels import LABEL, add_label
from tickloom.operators.windows import TRADE_ORDER, span_label
from tickloom.plans.config import Settings
from tickloom.plans.fixtures import HOUR, items, merged, priced, spiked, spots, table, ticks, trades
from tickloom.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SPANS = Settings().spans

# ---- common table expressions of the SQL side
EV = "ev as (select event_id, user_id as ticker, epoch_us(ts) as t, cast(ts as date) as date, ts, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events)"
TRADES = "trades as (select ticker, t as trade_ts, date, event_type, value as price, k as size, event_id from ev where event_type in ('click', 'purchase', 'signup'))"
QUOTES = "quotes as (select ticker, t as quote_ts, value as bid_price, value * (1e0 + k / 1e3) as ask_price, k % 7 as bid_size, k % 5 as ask_size, k % 3 as bid_exchange, k % 4 as ask_exchange, event_id as sequence_number from ev where event_type not in ('click', 'purchase', 'signup'))"
MERGED = "merged as (select t.*, q.* exclude (ticker) from trades t asof left join quotes q on t.ticker = q.ticker and t.trade_ts >= q.quote_ts)"
PRICED = "priced as (select *, ask_price - bid_price as spread, (ask_price + bid_price) / 2 as mid from merged where quote_ts is not null)"
SPIKED = "spiked as (select * replace (case when event_id % 97 = 0 then ask_price when event_id % 101 = 0 then bid_price * 100 else bid_price end as bid_price, case when event_id % 97 = 0 then bid_price when event_id % 101 = 0 then ask_price * 100 when event_id % 89 = 0 then bid_price * 8 else ask_price end as ask_price) from merged where quote_ts is not null)"
BASE_SPIKED = f"with {EV}, {TRADES}, {QUOTES}, {MERGED}, {SPIKED}, {PRICED.replace('from merged', 'from spiked')}"
BASE = f"with {EV}, {TRADES}, {QUOTES}, {MERGED}, {PRICED}"
ITEMS = "items as (select l_suppkey as underlying, l_partkey as ticker, cast(l_shipdate as date) as date, cast(l_shipdate as date) + cast(l_linenumber * 4 - 4 as integer) as expiry, cast(900 + l_partkey % 1000 as double) as strike, l_quantity as size from lineitem)"
SPOTS = "spots as (select s_suppkey as underlying, cast(1000 + s_suppkey % 400 as double) as spot from supplier where s_suppkey % 3 <> 0)"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


# ---- as-of join and labels
@query(f"{BASE} select ticker, trade_ts, price, quote_ts, bid_price, ask_price, sequence_number from merged")
def asof_backward(spark, d):
    return merged(spark, d).select("ticker", "trade_ts", "price", "quote_ts", "bid_price", "ask_price", "sequence_number")


def label_sql(h: int) -> str:
    return f"labelled as (select *, avg(price) over w as fut, count(*) over w as n_future, case when mid > 0 then avg(price) over w / mid - 1 end as y from priced window w as (partition by ticker order by trade_ts range between 1 following and {h * HOUR} following))"


def labelled(spark, d, h: int = 30) -> DataFrame:
    return add_label(priced(spark, d), h, ["ticker"], tick=HOUR)


@query(f"{BASE}, {label_sql(30)} select event_type, count(y) as n, round(avg(y), 6) as mean_return from labelled group by event_type")
def forward_return_by_type(spark, d):
    return labelled(spark, d).groupBy("event_type").agg(F.count(LABEL).alias("n"), F.round(F.avg(LABEL), 6).alias("mean_return"))


def _label_query(h: int) -> None:
    def run(spark, d):
        x = labelled(spark, d, h)
        return rounded(x.select("ticker", "trade_ts", F.col("future_avg_trade_price_5s").alias("fut"), F.col("n_future_trades_5s").alias("n_future"), F.col(LABEL).alias("y")), "fut", "y")

    query(f"{BASE}, {label_sql(h)} select ticker, trade_ts, round(fut, 6) as fut, n_future, round(y, 6) as y from labelled", f"label_h{h}")(run)


for _h in Settings().horizons:
    _label_query(_h)

# ---- symbols, clocks and filters
SYMBOL_SQL = "symbols as (select event_id, t, k, event_type, 'O:' || upper(event_type) || strftime(ts, '%y%m%d') || case when k % 2 = 0 then 'C' else 'P' end || lpad(cast(k * 1000 + 500 as varchar), 8, '0') as symbol from ev)"


def symbols(spark, d) -> DataFrame:
    x = ticks(spark, d)
    return x.select("event_id", "t", "k", "event_type", F.concat(F.lit("O:"), F.upper("event_type"), F.date_format("ts", "yyMMdd"), F.when(F.col("k") % 2 == 0, "C").otherwise("P"), F.lpad((F.col("k") * 1000 + 500).cast("string"), 8, "0")).alias("symbol"))


@query(f"with {EV}, {SYMBOL_SQL} select event_id, regexp_extract(symbol, '^O:([A-Z]+)[0-9]', 1) as underlying, cast(strptime(regexp_extract(symbol, '([0-9]{{6}})[CP]', 1), '%y%m%d') as date) as expiry, regexp_extract(symbol, '[0-9]([CP])', 1) as cp_flag, cast(right(symbol, 8) as integer) / 1000.0 as strike from symbols")
def parse_symbol_columns(spark, d):
    return symbols(spark, d).select("event_id", *(c.alias(n) for n, c in parse_symbol(F.col("symbol")).items()))


@query(f"with {EV}, {SYMBOL_SQL}, bad as (select event_id, k, case k % 4 when 0 then lower(symbol) when 1 then symbol || 'X' when 2 then replace(symbol, upper(event_type), upper(event_type) || '1') else replace(symbol, 'O:', '') end as symbol from symbols) select cast(k % 4 as bigint) as kind, count(*) filter (regexp_matches(symbol, '^(O:)?[A-Z]+[0-9]{{6}}[CP][0-9]{{8}}$')) as parsed, count(*) as n from bad group by 1")
def parse_symbol_reject(spark, d):
    k, s, e = F.col("k"), F.col("symbol"), F.upper("event_type")
    bad = F.when(k % 4 == 0, F.lower(s)).when(k % 4 == 1, F.concat(s, F.lit("X"))).when(k % 4 == 2, F.replace(s, e, F.concat(e, F.lit("1")))).otherwise(F.replace(s, F.lit("O:"), F.lit("")))
    x = symbols(spark, d).select((k % 4).alias("kind"), parse_symbol(bad)["underlying"].alias("u"))
    return x.groupBy("kind").agg(F.count("u").alias("parsed"), F.count(F.lit(1)).alias("n"))


@query(f"with {EV}, {SYMBOL_SQL} select event_id, symbol from symbols where regexp_matches(symbol, '^O:(CLICK|VIEW)[0-9]{{6}}[CP]')")
def symbol_regex_filter(spark, d):
    return symbols(spark, d).filter(of_roots(F.col("symbol"), ["CLICK", "VIEW"])).select("event_id", "symbol")


@query(f"with {EV}, {SYMBOL_SQL} select event_id, symbol from symbols where symbol like 'O:S%'")
def prefix_scan(spark, d):
    return io.scan_prefix(symbols(spark, d).withColumn("ticker", F.col("symbol")), "S").select("event_id", "symbol")


@query("select event_id, event_type from events where event_type in ('click', 'view')")
def isin_filter(spark, d):
    return table(spark, d, "events").filter(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as utc, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') as et, strftime(timezone('America/Chicago', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') as ct, cast(ts as date) as date from events")
def tz_columns(spark, d):
    x = ticks(spark, d).select("event_id", *(c.alias(n) for n, c in clock_columns(F.col("t") * 1000).items()))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return x.select("event_id", show("dt_utc").alias("utc"), show("dt_et").alias("et"), show("dt_ct").alias("ct"), "date")


@query("select event_id from events where cast(ts as time) between time '09:30:00' and time '16:00:00'")
def rth_filter(spark, d):
    return ticks(spark, d).filter(in_session(F.timestamp_micros("t"))).select("event_id")


@query(f"{BASE} select ticker, trade_ts, ask_exchange from merged where ask_exchange = bid_exchange")
def same_exchange(spark, d):
    return merged(spark, d).filter("ask_exchange = bid_exchange").select("ticker", "trade_ts", "ask_exchange")


@query(f"{BASE} select ticker, trade_ts, quote_ts from merged where quote_ts is not null")
def drop_any_null(spark, d):
    return merged(spark, d).na.drop("any").select("ticker", "trade_ts", "quote_ts")


@query("select event_id, try_cast(case event_id % 3 when 0 then 'n/a' when 1 then cast(event_id as varchar) || '.5' else cast(event_id as varchar) end as double) as v from events")
def coerce_numeric(spark, d):
    i = F.col("event_id")
    text = F.when(i % 3 == 0, "n/a").when(i % 3 == 1, F.concat(i.cast("string"), F.lit(".5"))).otherwise(i.cast("string"))
    return table(spark, d, "events").select("event_id", coerce(text).alias("v"))


# ---- cleaning
DEVIATION = """flagged0 as (select *, median(spread) over (partition by ticker, date) as day_median_spread,
  case when count(mid) over c >= 25 then median(mid) over c end as rolling_med_mid from priced
  window c as (partition by ticker order by date, trade_ts rows between 25 preceding and 24 following)),
flagged1 as (select *, abs(mid - rolling_med_mid) as abs_dev_mid from flagged0),
flagged2 as (select *, case when count(abs_dev_mid) over c >= 25 then avg(abs_dev_mid) over c end as rolling_mean_abs_dev_mid from flagged1
  window c as (partition by ticker order by date, trade_ts rows between 25 preceding and 24 following)),
flagged as (select *,
  (price <= 0 or size <= 0 or bid_price <= 0 or ask_price <= 0 or bid_size <= 0 or ask_size <= 0) as c1,
  spread < 0 as c2, (bid_size <= 1 and ask_size <= 1) as c3, spread > 50 * day_median_spread as c4,
  coalesce(abs_dev_mid > 10 * rolling_mean_abs_dev_mid, false) as c5, coalesce(ask_price / nullif(bid_price, 0) > 5, false) as c6,
  (price < bid_price - spread or price > ask_price + spread) as c7 from flagged2)"""


def flagged(spark, d) -> DataFrame:
    return clean.flag_rules(priced(spark, d))


def _rule_query(rule: str) -> None:
    """Crossed quotes, outliers and wide ratios are put in where the tables have none."""
    base, rows = (BASE_SPIKED, spiked) if rule in ("c2", "c5", "c6") else (BASE, priced)
    query(f"{base}, {DEVIATION} select ticker, trade_ts from flagged where {rule}", f"rule_{rule}")(lambda spark, d: clean.flag_rules(rows(spark, d)).filter(F.col(rule)).select("ticker", "trade_ts"))


for _rule in clean.RULES:
    _rule_query(_rule)
_BAD = " or ".join(clean.RULES)
_COUNTS = " union all ".join(f"select '{long}' as rule, count(*) filter ({short}) as count from flagged" for short, long in [*clean.RULES.items(), (f"({_BAD})", clean.ANY)])


@query(f"{BASE}, {DEVIATION} {_COUNTS}")
def rule_summary(spark, d):
    return clean.rule_counts(flagged(spark, d))


@query(f"{BASE}, {DEVIATION} select ticker, trade_ts, round(spread, 6) as spread, round(mid, 6) as mid from flagged where not ({_BAD})")
def clean_rows(spark, d):
    return rounded(clean.clean_rows(priced(spark, d)).select("ticker", "trade_ts", "spread", "mid"), "spread", "mid")


@query(f"{BASE}, {DEVIATION} select ticker, trade_ts, round(rolling_med_mid, 9) as rolling_med_mid from flagged")
def rolling_median_centered(spark, d):
    return rounded(clean.add_rolling_deviation(priced(spark, d)).select("ticker", "trade_ts", "rolling_med_mid"), "rolling_med_mid", places=9)


@query(f"{BASE}, {DEVIATION} select ticker, trade_ts, round(rolling_mean_abs_dev_mid + 3e-8, 6) as mad from flagged")
def rolling_mad(spark, d):
    """Values lie on a decimal grid; a small shift keeps rounding off its ties."""
    return rounded(clean.add_rolling_deviation(priced(spark, d)).select("ticker", "trade_ts", (F.col("rolling_mean_abs_dev_mid") + 3e-8).alias("mad")), "mad")


@query(f"{BASE} select ticker, trade_ts, round(median(spread) over (partition by ticker, date), 6) as day_median_spread from priced")
def daily_median_spread(spark, d):
    return rounded(flagged(spark, d).select("ticker", "trade_ts", "day_median_spread"), "day_median_spread")


DAY = 86_400_000_000


@query(f"""{BASE}, days as (select * replace (trade_ts - trade_ts % {DAY} as trade_ts) from priced),
merged1 as (select ticker, trade_ts, median(price) as price, median(ask_price) as ask_price, median(bid_price) as bid_price, cast(sum(size) as bigint) as size,
  cast(sum(ask_size) as bigint) as ask_size, cast(sum(bid_size) as bigint) as bid_size, arg_min(sequence_number, quote_ts) as sequence_number, min(quote_ts) as quote_ts from days group by ticker, trade_ts)
select ticker, trade_ts, round(price, 9) as price, round(ask_price, 9) as ask_price, round(bid_price, 9) as bid_price, size, ask_size, bid_size, sequence_number, quote_ts,
  round(ask_price - bid_price, 9) as spread, round((ask_price + bid_price) / 2, 9) as mid from merged1""")
def dedup_ticks(spark, d):
    x = priced(spark, d).withColumn("trade_ts", F.col("trade_ts") - F.col("trade_ts") % DAY)
    out = clean.merge_simultaneous(x)
    cols = ["price", "ask_price", "bid_price", "spread", "mid"]
    return rounded(out, *cols, places=9).select("ticker", "trade_ts", "price", "ask_price", "bid_price", "size", "ask_size", "bid_size", "sequence_number", "quote_ts", "spread", "mid")


# ---- ties: trades of one day are simultaneous, and most of them meet one quote
TIED = f"tied as (select * replace (trade_ts - trade_ts % {DAY} as trade_ts), case when size % 5 = 0 then null else event_type end as conditions from priced)"


def tied(spark, d) -> DataFrame:
    return priced(spark, d).withColumns({"trade_ts": F.col("trade_ts") - F.col("trade_ts") % DAY, "conditions": F.when(F.col("size") % 5 != 0, F.col("event_type")), TRADE_ORDER: F.col("event_id")})


@query(f"{BASE}, {TIED} select ticker, trade_ts, first(conditions order by quote_ts, sequence_number, event_id) filter (where conditions is not null) as conditions, count(*) as n from tied group by ticker, trade_ts")
def dedup_ties(spark, d):
    x = tied(spark, d)
    return clean.merge_simultaneous(x).select("ticker", "trade_ts", "conditions").join(x.groupBy("ticker", "trade_ts").agg(F.count(F.lit(1)).alias("n")), ["ticker", "trade_ts"])


@query(f"{BASE}, {TIED}, m as (select event_id, case when count(mid) over c >= 25 then median(mid) over c end as v from tied window c as (partition by ticker order by date, trade_ts, event_id rows between 25 preceding and 24 following)) select event_id, round(v, 9) as rolling_med_mid from m")
def rolling_median_ties(spark, d):
    return rounded(clean.add_rolling_deviation(tied(spark, d)).select("event_id", "rolling_med_mid"), "rolling_med_mid", places=9)


# ---- direction and features
DIRECTION = """moves as (select *, sign(price - lag(price) over (partition by ticker order by trade_ts)) as tick from mids),
carried as (select *, last_value(case when tick <> 0 then tick end ignore nulls) over (partition by ticker order by trade_ts rows between unbounded preceding and current row) as carry from moves),
directed as (select *, cast(case when price is null then 0 when mid is not null and price <> mid then sign(price - mid)
  else coalesce(case when tick = 0 then coalesce(carry, 0) else tick end, 0) end as integer) as dir_proxy from carried)"""
MIDS = "mids as (select *, (ask_price + bid_price) / 2 as mid, ask_price - bid_price as spread from merged)"


def mids(spark, d) -> DataFrame:
    return clean.add_spread(merged(spark, d))


@query(f"{BASE}, {MIDS}, {DIRECTION} select ticker, trade_ts, dir_proxy from directed")
def lee_ready(spark, d):
    return add_direction(mids(spark, d), ["ticker"], seq="event_id").select("ticker", "trade_ts", "dir_proxy")


TERMS = """lags as (select *, lag(price, 1) over o as p1, lag(price, 2) over o as p2 from directed window o as (partition by ticker order by trade_ts)),
terms as (select *, case when price > 0 and p1 > 0 and p2 > 0 then ln(price / p1) * ln(p1 / p2) end as cov,
  case when mid > 0 then (ask_price - bid_price) / mid end as quoted, case when ask_size + bid_size > 0 then (ask_size - bid_size) / cast(ask_size + bid_size as double) end as lob,
  size * dir_proxy as signed, case when price > 0 and mid > 0 then ln(price / mid) * dir_proxy * size * price end as effn, case when price > 0 then size * price end as effd from lags)"""


def family_sql(family: str, w: str, left: float, right: float) -> str:
    volume = f"coalesce(sum(cast(size as double)) over {w}, 0)"
    last, first = f"(arg_max({{'m': mid}}, trade_ts) over {w}).m", f"(arg_min({{'m': mid}}, trade_ts) over {w}).m"
    n = f"count(*) over {w}"
    return {
        "breadth": f"case when {n} > 0 then cast({n} as double) end",
        "immediacy": f"{right - left:g}e0 / nullif({n}, 0)",
        "volume_all": f"case when {n} > 0 then {volume} end",
        "volume_avg": f"{volume} / nullif({n}, 0)",
        "volume_max": f"max(cast(size as double)) over {w}",
        "lambda_": f"case when {n} > 0 and {volume} > 0 then ({last} - {first}) / {volume} end",
        "lob_imbalance": f"avg(lob) over {w}",
        "txn_imbalance": f"case when {n} > 0 and {volume} > 0 then coalesce(sum(cast(signed as double)) over {w}, 0) / {volume} end",
        "past_return": f"case when {last} > 0 then 1 - avg(price) over {w} / {last} end",
        "turnover": f"case when {n} > 0 and event_id > 0 then {volume} / event_id end",
        "autocov": f"avg(cov) over {w}",
        "quoted_spread": f"avg(quoted) over {w}",
        "effective_spread": f"case when coalesce(sum(effd) over {w}, 0) > 0 then coalesce(sum(effn) over {w}, 0) / sum(effd) over {w} end",
    }[family]


def features_sql(families, spans=SPANS) -> str:
    cols, frames = [], []
    for i, (left, right) in enumerate(spans):
        frames.append(f"w{i} as (partition by ticker order by trade_ts range between {right * HOUR - 1} preceding and {left * HOUR} preceding)")
        cols += [f"round({family_sql(f, f'w{i}', left, right)}, 6) as {features.column_name(f, left, right)}" for f in families]
    return f"{BASE}, {MIDS}, {DIRECTION}, {TERMS} select ticker, trade_ts, {', '.join(cols)} from terms window {', '.join(frames)}"


def feature_rows(spark, d, families, spans=SPANS) -> DataFrame:
    names = [features.column_name(f, *s) for s in spans for f in families]
    x = features.add_features(mids(spark, d), spans, ["ticker"], seq="event_id", tick=HOUR, turnover_base="event_id", families=families)
    return rounded(x.select("ticker", "trade_ts", *names), *names)


def _feature_query(family: str) -> None:
    query(features_sql([family]), f"feat_{family.rstrip('_')}")(lambda spark, d: feature_rows(spark, d, [family]))


for _family in features.FAMILIES:
    _feature_query(_family)


@query(features_sql(features.FAMILIES))
def feat_all_spans(spark, d):
    return feature_rows(spark, d, features.FAMILIES)


_SELECTED = sorted(features.column_name(f, *s) for f in features.FAMILIES if f != "lambda_" for s in SPANS)


@query("select * from (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_SELECTED)) + ") as v(position, feature)")
def predictor_select(spark, d):
    table_ = features.add_features(mids(spark, d), SPANS, ["ticker"], seq="event_id", tick=HOUR, turnover_base="event_id")
    used = features.filled_columns(table_, features.predictor_columns(table_.columns))
    return spark.createDataFrame(list(enumerate(used)), "position int, feature string")


def _filled_sql(spans) -> str:
    held = [f for f in features.FAMILIES if f != "turnover"]
    counts = [f"select '{features.column_name(f, *s)}' as feature, count({features.column_name(f, *s)}) as n from f" for f in held for s in spans]
    counts += [f"select '{features.column_name('turnover', *s)}', 0" for s in spans]
    return f"with f as ({features_sql(held, spans)}), n as ({' union all '.join(counts)}) select feature from n where n > 0 and regexp_matches(feature, '^({'|'.join(features.FAMILIES)})__')"


@query(_filled_sql(SPANS[:2]))
def prune_all_null(spark, d):
    """Without a base for the turnover its columns are all null and go."""
    x = features.add_features(mids(spark, d), SPANS[:2], ["ticker"], seq="event_id", tick=HOUR)
    used = features.filled_columns(x, features.predictor_columns(x.columns))
    return spark.createDataFrame([(c,) for c in used], "feature string")


_OCC = " union all ".join(f"select ticker, '{span_label(a, b)}' as span, count(*) over (partition by ticker order by trade_ts range between {b * HOUR - 1} preceding and {a * HOUR} preceding) as n from trades" for a, b in SPANS)


@query(f"with {EV}, {TRADES}, c as ({_OCC}), g as (select ticker, span, avg(cast(n > 0 as integer)) as a, avg(n) as b, median(n) as c from c group by ticker, span) select span, round(avg(a), 6) as non_empty_ratio, round(avg(b), 6) as avg_n_trades_in_window, round(avg(c), 6) as median_n_trades_in_window from g group by span")
def span_occupancy(spark, d):
    out = features.span_occupancy(trades(spark, d), SPANS, ["ticker"], tick=HOUR)
    return rounded(out, *out.columns[1:])


# ---- selection
DTE = "dte as (select *, cast(expiry - date as integer) as dte from items)"
FALL = "fall as (select underlying, sum(strike * greatest(size, 1e-9)) / sum(greatest(size, 1e-9)) as fallback from dte where dte between 0 and 14 group by underlying)"
SPOTTED = "spotted as (select d.*, coalesce(s.spot, f.fallback) as spot from dte d left join spots s using (underlying) left join fall f using (underlying) where coalesce(s.spot, f.fallback) is not null)"
MONEY = "money as (select *, abs(strike / spot - 1) as abs_moneyness from spotted where dte between 0 and 14)"
PICK = f"with {ITEMS}, {SPOTS}, {DTE}, {FALL}, {SPOTTED}, {MONEY}"


def near_money(spark, d) -> DataFrame:
    x = select.add_spot(select.add_dte(items(spark, d)), spots(spark, d))
    return select.add_moneyness(select.in_dte(x))


@query(f"{PICK} select dte, count(*) as n from dte group by dte")
def dte(spark, d):
    return select.add_dte(items(spark, d)).groupBy("dte").agg(F.count(F.lit(1)).alias("n"))


@query(f"{PICK} select underlying, round(min(spot), 6) as spot, count(*) as n from spotted group by underlying")
def spot_lookup(spark, d):
    x = select.add_spot(select.add_dte(items(spark, d)), spots(spark, d))
    return x.groupBy("underlying").agg(F.round(F.min("spot"), 6).alias("spot"), F.count(F.lit(1)).alias("n"))


@query(f"{PICK} select underlying, round(fallback, 6) as fallback from fall")
def spot_fallback(spark, d):
    return rounded(select.fallback_spot(select.add_dte(items(spark, d))), "fallback")


@query(f"{PICK} select ticker, underlying, dte, round(abs_moneyness, 6) as abs_moneyness from money")
def moneyness(spark, d):
    return rounded(near_money(spark, d).select("ticker", "underlying", "dte", "abs_moneyness"), "abs_moneyness")


TOP = "vol as (select underlying, ticker, sum(size) as volume from items group by 1, 2), ranked as (select *, cast(row_number() over (partition by underlying order by volume desc, ticker) as integer) as rank from vol)"


@query(f"with {ITEMS}, {TOP} select underlying, ticker, volume, rank from ranked where rank <= 50")
def top_contracts(spark, d):
    return select.top_contracts(items(spark, d))


CAPS = "caps as (select m.*, c.moneyness from money m join (values (0.08::double), (0.10::double), (0.12::double)) as c(moneyness) on m.abs_moneyness <= c.moneyness)"
CELLS = "tops as (select underlying, moneyness, ticker, row_number() over (partition by underlying, moneyness order by sum(size) desc, ticker) as r from caps group by 1, 2, 3), kept as (select c.* from caps c join tops t using (underlying, moneyness, ticker) where r <= 50)"


@query(f"{PICK}, {CAPS}, {CELLS} select underlying, moneyness, count(*) as n_feat_rows from kept group by 1, 2 having count(*) >= 20")
def grid_counts(spark, d):
    x = select.keep_top(select.explode_caps(near_money(spark, d), (0.08, 0.10, 0.12)), ("underlying", "moneyness"))
    return select.at_least(x, ["underlying", "moneyness"], 20).groupBy("underlying", "moneyness").agg(F.count(F.lit(1)).alias("n_feat_rows"))


@query(f"with {EV}, {TRADES} select ticker, trade_ts from (select *, count(*) over (partition by ticker) as n from trades) where n >= 40")
def min_group_rows(spark, d):
    return select.at_least(trades(spark, d), ["ticker"], 40).select("ticker", "trade_ts")


# ---- files: written, read and written again as the experiment does it
QUOTE_SQL = "select symbol as ticker, cast(k % 3 as integer) as ask_exchange, k * 1.5e0 as ask_price, k as ask_size, cast(k % 4 as integer) as bid_exchange, k * 1.25e0 as bid_price, k % 7 as bid_size, event_id as sequence_number, t * 1000 as sip_timestamp from symbols"


def quote_file(spark, d, files: int | None = 3) -> str:
    """Quotes in so many files, or in as many as it takes, one after the other by sequence number."""
    k, path = F.col("k"), io.scratch(spark, "quotes.csv")
    x = symbols(spark, d).select(
        F.lit("x").alias("tape"), F.col("symbol").alias("ticker"), (k % 3).alias("ask_exchange"), (k * 1.5).alias("ask_price"), k.alias("ask_size"), (k % 4).alias("bid_exchange"),
        (k * 1.25).alias("bid_price"), (k % 7).alias("bid_size"), F.col("event_id").alias("sequence_number"), (F.col("t") * 1000).alias("sip_timestamp"),
    )
    x = x.repartition(files) if files else x.orderBy("sequence_number")
    x.write.csv(path, header=True, compression="gzip")
    return path


@query(f"with {EV}, {SYMBOL_SQL} {QUOTE_SQL} where regexp_matches(symbol, '^O:(VIEW|ERROR)[0-9]{{6}}[CP]')")
def csv_to_parquet(spark, d):
    path = io.scratch(spark, "quotes.parquet")
    io.write_quotes(io.filter_quotes(io.load_quotes(spark, quote_file(spark, d)), ("VIEW", "ERROR")), path)
    return spark.read.parquet(path)


@query("select event_id as sequence_number from events order by event_id limit 50")
def csv_first_rows(spark, d):
    return io.load_quotes(spark, quote_file(spark, d, None), rows=50).select("sequence_number")


@query(f"with {EV}, {SYMBOL_SQL} select symbol as ticker, k * 0.25e0 as price, k as size, upper(symbols.event_type) as underlying, cast(ts as date) as date, cast(ts as date) as expiry, case when k % 2 = 0 then 'C' else 'P' end as cp_flag, k + 0.5e0 as strike from symbols join events using (event_id) where symbols.event_type in ('click', 'signup')")
def trades_to_parquet(spark, d):
    source, path = io.scratch(spark, "trades.csv"), io.scratch(spark, "trades.parquet")
    x = symbols(spark, d).select(F.col("symbol").alias("ticker"), F.lit("209").alias("conditions"), F.lit(0).alias("correction"), F.lit(1).alias("exchange"), (F.col("k") * 0.25).alias("price"), (F.col("t") * 1000).alias("sip_timestamp"), F.col("k").alias("size"))
    x.write.csv(source, header=True)
    io.write_trades(io.load_trades(spark, source, ["CLICK", "SIGNUP"]), path)
    return spark.read.parquet(path).select("ticker", "price", "size", "underlying", "date", "expiry", "cp_flag", "strike")


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def summary_csv(spark, d):
    path = io.scratch(spark, "summary.csv")
    for _ in range(2):  # the second one replaces the first
        io.write_summary(rounded(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", places=4), path)
    return spark.read.csv(path, header=True, schema="event_type string, n bigint, total double")


@query("select 'S' || s_suppkey as underlying, case when s_suppkey % 3 <> 0 then cast(1000 + s_suppkey % 400 as double) end as spot from supplier")
def spot_csv(spark, d):
    path, k = io.scratch(spark, "spots.csv"), F.col("s_suppkey")
    px = F.when(k % 3 != 0, (1000 + k % 400).cast("string")).otherwise("n/a")
    table(spark, d, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("Ticker"), px.alias("px"), F.lit("OK").alias("Status")).write.csv(path, header=True)
    return io.read_spots(spark, path, "px")


# ---- rolling refits
TRAIN, STEP, LEAST = 120 * HOUR, 24 * HOUR, 3
GRID = f"rows_ as (select ticker, trade_ts, price, y from labelled where y is not null), grid as (select ticker, min(trade_ts) + {TRAIN} as first, max(trade_ts) as last from rows_ group by ticker having min(trade_ts) + {TRAIN} < max(trade_ts)), grid2 as (select *, cast(floor((last - first) / {STEP}e0) as bigint) + 1 as refits from grid)"
ASSIGN = f"""test as (select r.*, cast(floor((trade_ts - first) / {STEP}e0) as bigint) as refit from rows_ r join grid2 using (ticker) where trade_ts >= first),
train as (select ticker, trade_ts, price, y, unnest(generate_series(greatest(cast(floor((trade_ts - first) / {STEP}e0) as bigint) + 1, 0), least(cast(floor((trade_ts + {TRAIN} - first) / {STEP}e0) as bigint), refits - 1))) as refit from rows_ join grid2 using (ticker))"""
BASELINE = f"means as (select ticker, refit, avg(y) as y_pred, count(*) as n_train from train group by 1, 2 having count(*) >= {LEAST}), pred as (select t.ticker, trade_ts, price, y, t.refit, y_pred, n_train from test t join means m on t.ticker = m.ticker and t.refit = m.refit)"
ROLL = f"{BASE}, {label_sql(30)}, {GRID}, {ASSIGN}, {BASELINE}"


def label_rows(spark, d) -> DataFrame:
    return labelled(spark, d).filter(F.col(LABEL).isNotNull()).select("ticker", "trade_ts", "price", F.col(LABEL).alias("y"))


@query(f"{BASE}, {label_sql(30)} select ticker, trade_ts from labelled qualify count(y) over (partition by ticker) >= 30")
def min_labels(spark, d):
    return select.at_least(labelled(spark, d), ["ticker"], 30, LABEL).select("ticker", "trade_ts")


@query(f"{BASE}, {label_sql(30)} select ticker, trade_ts, round(y, 6) as y from labelled where event_id % 7 > 2 and y is not null")
def valid_labels(spark, d):
    i = F.col("event_id") % 7
    y = F.when(i == 1, F.lit(float("nan"))).when(i == 2, F.lit(float("inf"))).when(i > 2, F.col(LABEL))
    return rounded(models.valid_labels(labelled(spark, d).withColumn("y", y), "trade_ts", "y").select("ticker", "trade_ts", "y"), "y")


def baseline(spark, d) -> DataFrame:
    return rolling.mean_baseline(label_rows(spark, d), ["ticker"], "trade_ts", "y", TRAIN, STEP, LEAST)


@query(f"{ROLL} select ticker, first, last, refits from grid2")
def refit_grid(spark, d):
    return rolling.refit_grid(label_rows(spark, d), ["ticker"], "trade_ts", TRAIN, STEP)


@query(f"{ROLL} select ticker, trade_ts, refit, true as test from test union all select ticker, trade_ts, refit, false from train")
def train_test_assign(spark, d):
    return rolling.assign(label_rows(spark, d), ["ticker"], "trade_ts", TRAIN, STEP).select("ticker", "trade_ts", "refit", "test")


@query(f"{ROLL} select ticker, trade_ts, refit, round(y, 6) as y, round(y_pred, 6) as y_pred, n_train from pred")
def rolling_mean_baseline(spark, d):
    return rounded(baseline(spark, d).select("ticker", "trade_ts", "refit", "y", "y_pred", "n_train"), "y", "y_pred")


@query(f"{ROLL} select ticker, refit, count(*) as n_train, round(median(price), 6) as price__median from train group by 1, 2")
def impute_median(spark, d):
    return rounded(rolling.window_statistics(label_rows(spark, d), ["ticker"], "trade_ts", ["price"], TRAIN, STEP).select("ticker", "refit", "n_train", "price__median"), "price__median")


@query(f"{ROLL} select ticker, refit, round(avg(price), 6) as price__mean, round(stddev_pop(price), 5) as price__std from train group by 1, 2")
def standardize_pop(spark, d):
    x = rolling.window_statistics(label_rows(spark, d), ["ticker"], "trade_ts", ["price"], TRAIN, STEP)
    return rounded(rounded(x.select("ticker", "refit", "price__mean", "price__std"), "price__mean"), "price__std", places=5)


# ---- models: a few refits over all trades of a type
FIT_SPANS = ((0, 20), (20, 80))


def _fit_query(model: str) -> None:
    def run(spark, d):
        x = features.add_features(labelled(spark, d).withColumn("dir_proxy", F.lit(1)), FIT_SPANS, ["ticker"], seq="event_id", tick=HOUR)
        used = features.predictor_columns(x.columns)
        out = models.rolling_predict(x, used, [model], ["event_type"], train=240 * HOUR, step=120 * HOUR, least=200, keep=["ticker"])
        return out.groupBy("event_type", "refit", "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y_pred"), 6).alias("mean_pred"))

    query(None, {"Lasso": "fit_lasso", "Ridge": "fit_ridge", "ElasticNet": "fit_enet", "RandomForest": "fit_rf", "XGBoost": "fit_gbt"}[model])(run)


for _model in models.MODELS:
    _fit_query(_model)

# ---- metrics and plot data
R2 = "case when count(*) >= {least} then case when var_pop(y) > 0 then 1 - sum((y - y_pred) * (y - y_pred)) / (var_pop(y) * count(*)) when sum((y - y_pred) * (y - y_pred)) = 0 then 1.0 else 0.0 end end"
_EVAL = f"count(*) as n, round(sqrt(avg((y - y_pred) * (y - y_pred))), 6) as rmse, round({R2.format(least=2)}, 6) as r2, round(avg(cast(sign(y) = sign(y_pred) as integer)), 6) as dir_acc"
TWO = "two as (select 'mean' as model, y, y_pred from pred union all select 'zero', y, 0.0 from pred)"


def two_models(spark, d) -> DataFrame:
    b = baseline(spark, d).select("y", "y_pred")
    return b.withColumn("model", F.lit("mean")).unionByName(b.withColumns({"model": F.lit("zero"), "y_pred": F.lit(0.0)}))


@query(f"{ROLL} select refit, {_EVAL} from pred group by refit")
def eval_metrics(spark, d):
    return rounded(metrics.evaluate(baseline(spark, d), ["refit"], "y"), "rmse", "r2", "dir_acc")


@query(f"{ROLL}, {TWO}, e as (select model, {_EVAL} from two group by model) select model, 'rmse' as metric, rmse as value from e union all select model, 'r2', r2 from e union all select model, 'dir_acc', dir_acc from e")
def model_compare(spark, d):
    return rounded(metrics.comparison(two_models(spark, d), y="y"), "value")


_WIDE = 24 * HOUR
_BINS = f"b as (select trade_ts - trade_ts % {_WIDE} as bin, count(*) as n, {R2.format(least=30)} as bin_r2 from pred group by 1), spine as (select unnest(generate_series((select min(bin) from b), (select max(bin) from b), {_WIDE})) as bin), bins as (select s.bin, coalesce(n, 0) as n, bin_r2 from spine s left join b using (bin))"


@query(f"{ROLL}, {_BINS} select bin, n, round(bin_r2, 6) as bin_r2 from bins")
def bin_r2(spark, d):
    return rounded(metrics.bin_r2(baseline(spark, d), "trade_ts", _WIDE, y="y"), "bin_r2")


@query(f"{ROLL}, {_BINS} select bin, round(case when count(bin_r2) over w >= 3 then avg(bin_r2) over w end, 6) as rolling_r2 from bins window w as (order by bin rows between 5 preceding and current row)")
def rolling_r2(spark, d):
    return rounded(metrics.rolling_r2(baseline(spark, d), "trade_ts", _WIDE, y="y").select("bin", "rolling_r2"), "rolling_r2")


@query(f"{ROLL}, h as (select 'mean' as model, trade_ts, y, y_pred from pred union all select 'zero', trade_ts, y, 0.0 from pred), b as (select model, trade_ts - trade_ts % {_WIDE} as bin, count(*) as n, {R2.format(least=30)} as bin_r2 from h group by 1, 2), spine as (select model, unnest(generate_series(min(bin), max(bin), {_WIDE})) as bin from b group by model), bins as (select s.model, s.bin, bin_r2 from spine s left join b on s.model = b.model and s.bin = b.bin) select model, bin, round(case when count(bin_r2) over w >= 3 then avg(bin_r2) over w end, 6) as rolling_r2 from bins window w as (partition by model order by bin rows between 5 preceding and current row)")
def multi_model_rolling_r2(spark, d):
    b = baseline(spark, d).select("trade_ts", "y", "y_pred")
    both = b.withColumn("model", F.lit("mean")).unionByName(b.withColumns({"model": F.lit("zero"), "y_pred": F.lit(0.0)}))
    return rounded(metrics.rolling_r2(both, "trade_ts", _WIDE, ["model"], y="y").select("model", "bin", "rolling_r2"), "rolling_r2")


@query(f"{ROLL} select cast(hour(make_timestamp(trade_ts)) as integer) as hour, round(avg(cast(sign(y) = sign(y_pred) as integer)), 6) as dir_acc from pred group by 1")
def hourly_dir_acc(spark, d):
    clock = (F.pmod(F.col("trade_ts"), F.lit(DAY)) / HOUR).cast("int")
    at = baseline(spark, d).withColumn("clock", F.make_timestamp_ntz(F.lit(2000), F.lit(1), F.lit(1), clock, F.lit(0), F.lit(0.0)))
    return rounded(metrics.hourly_accuracy(at, "clock", "y"), "dir_acc")


@query(f"{ROLL} select round(y, 6) as y, round(y_pred, 6) as y_pred from pred")
def pred_pairs(spark, d):
    return rounded(metrics.pairs(baseline(spark, d), "y"), "y", "y_pred")


@query(f"{ROLL} select round(y_pred, 6) as y_pred, round(y - y_pred, 6) as residual from pred")
def residuals(spark, d):
    return rounded(metrics.residuals(baseline(spark, d), "y"), "y_pred", "residual")


@query(f"{ROLL}, r as (select y - y_pred as e from pred), m as (select min(e) as a, max(e) as b from r) select cast(least(floor((e - a) / ((b - a) / 80)), 79) as integer) as bin, count(*) as n from r, m group by 1")
def residual_hist(spark, d):
    return metrics.residual_histogram(baseline(spark, d), y="y").select("bin", "n")


COEFS = "coefs as (select day(ts) % 5 as refit_time, 'f' || k as feature, value - 30 as coef from ev)"


def coefs(spark, d) -> DataFrame:
    return ticks(spark, d).select((F.dayofmonth("ts") % 5).alias("refit_time"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("feature"), (F.col("value") - 30).alias("coef"))


_TOPF = "top as (select feature, avg(abs(coef)) as mean_abs from coefs group by feature order by mean_abs desc, feature limit 20)"


@query(f"with {EV}, {COEFS}, {_TOPF} select feature, round(mean_abs, 6) as mean_abs from top")
def coef_top(spark, d):
    return rounded(metrics.top_coefficients(coefs(spark, d)), "mean_abs")


_CELL = ", ".join(f"round(avg(coef) filter (refit_time = {i}), 6) as \"{i}\"" for i in range(5))


@query(f"with {EV}, {COEFS}, {_TOPF}, ranked as (select feature, cast(row_number() over (order by mean_abs desc, feature) as integer) as rank from top) select feature, rank, {_CELL} from coefs join ranked using (feature) group by feature, rank")
def coef_pivot(spark, d):
    return rounded(metrics.coefficient_heatmap(coefs(spark, d), range(5)), *map(str, range(5)))
