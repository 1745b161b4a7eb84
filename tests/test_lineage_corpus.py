"""Column lineage of two warehouse pipelines, a batch and a streaming one, down to their base columns."""

from pyspark.sql import functions as F

from heddlework.operators import lineage, selects

# Statements as facts: target, tables with their aliases, and output columns with the columns they read. Names are fixed values.
BATCH = [
    ("tmp_order_detail", {"o": "ods.order_fact", "u": "dim.user_dim", "p": "dim.product_dim"}, {"order_id": "o.order_id", "user_id": "o.user_id", "user_name": "u.user_name", "product_id": "o.product_id", "product_name": "p.product_name", "brand_name": "p.brand_name", "quantity": "o.quantity", "pay_amount": "o.pay_amount", "order_time": "o.order_time"}),
    ("tmp_user_rfm", {"tmp_order_detail": "tmp_order_detail"}, {"user_id": "user_id", "user_name": "user_name", "recency_days": "order_time", "frequency": "order_id", "monetary": "pay_amount"}),
    ("tmp_user_rfm_scored", {"tmp_user_rfm": "tmp_user_rfm"}, {"user_id": "user_id", "user_name": "user_name", "recency_days": "recency_days", "frequency": "frequency", "monetary": "monetary", "r_score": "recency_days", "f_score": "frequency", "m_score": "monetary"}),
    ("ads.user_rfm_analysis", {"tmp_user_rfm_scored": "tmp_user_rfm_scored"}, {"user_id": "user_id", "user_name": "user_name", "recency_days": "recency_days", "frequency": "frequency", "monetary": "monetary", "rfm_score": "r_score f_score m_score", "user_segment": "r_score f_score m_score"}),
    ("tmp_product_sales_agg", {"tmp_order_detail": "tmp_order_detail"}, {"product_id": "product_id", "product_name": "product_name", "brand_name": "brand_name", "sale_quantity": "quantity", "sale_amount": "pay_amount", "order_count": "order_id", "buyer_count": "user_id"}),
    ("dws.product_sales_daily", {"tmp_product_sales_agg": "tmp_product_sales_agg"}, {"product_id": "product_id", "product_name": "product_name", "brand_name": "brand_name", "sale_quantity": "sale_quantity", "sale_amount": "sale_amount", "order_count": "order_count", "buyer_count": "buyer_count"}),
]
BATCH_WANTED = {
    "ads.user_rfm_analysis": {"user_id": "ods.order_fact.user_id", "user_name": "dim.user_dim.user_name", "recency_days": "ods.order_fact.order_time", "frequency": "ods.order_fact.order_id", "monetary": "ods.order_fact.pay_amount", "rfm_score": "ods.order_fact.order_id ods.order_fact.order_time ods.order_fact.pay_amount", "user_segment": "ods.order_fact.order_id ods.order_fact.order_time ods.order_fact.pay_amount"},
    "dws.product_sales_daily": {"product_id": "ods.order_fact.product_id", "product_name": "dim.product_dim.product_name", "brand_name": "dim.product_dim.brand_name", "sale_quantity": "ods.order_fact.quantity", "sale_amount": "ods.order_fact.pay_amount", "order_count": "ods.order_fact.order_id", "buyer_count": "ods.order_fact.user_id"},
}
STREAM = [
    ("order_detail", {"o": "orders", "u": "user_info", "p": "product_info"}, {"order_id": "o.order_id", "user_id": "o.user_id", "user_name": "u.user_name", "product_id": "o.product_id", "product_name": "p.product_name", "category": "p.category", "quantity": "o.quantity", "amount": "o.amount", "order_time": "o.order_time"}),
    ("user_behavior_window", {"user_events": "user_events"}, {"user_id": "user_id", "window_start": "event_time", "window_end": "event_time", "uv_count": "page_url"}),
    ("product_sales_agg", {"order_detail": "order_detail"}, {"product_id": "product_id", "product_name": "product_name", "category": "category", "total_quantity": "quantity", "total_sales": "amount", "stat_date": "order_time"}),
    ("product_sales_rank", {"product_sales_agg": "product_sales_agg"}, {"product_id": "product_id", "product_name": "product_name", "category": "category", "total_quantity": "total_quantity", "total_sales": "total_sales", "rank_num": "stat_date total_sales", "stat_date": "stat_date"}),
    ("realtime_alerts", {"order_detail": "order_detail"}, {"alert_id": "order_id", "alert_type": "", "user_id": "user_id", "alert_message": "user_name amount", "alert_time": "order_time"}),
    ("user_behavior_stats", {"user_behavior_window": "user_behavior_window"}, {"user_id": "user_id", "window_start": "window_start", "window_end": "window_end", "uv_count": "uv_count"}),
]
STREAM_WANTED = {
    "product_sales_rank": {"product_id": "orders.product_id", "product_name": "product_info.product_name", "category": "product_info.category", "total_quantity": "orders.quantity", "total_sales": "orders.amount", "rank_num": "orders.amount orders.order_time", "stat_date": "orders.order_time"},
    "realtime_alerts": {"alert_id": "orders.order_id", "user_id": "orders.user_id", "alert_message": "orders.amount user_info.user_name", "alert_time": "orders.order_time"},
    "user_behavior_stats": {"user_id": "user_events.user_id", "window_start": "user_events.event_time", "window_end": "user_events.event_time", "uv_count": "user_events.page_url"},
}


def base_columns(spark, statements):
    items, refs, tables, catalog = [], [], [], []
    for s, (target, sources, columns) in enumerate(statements):
        tables += [(s, 0, i, alias, name) for i, (alias, name) in enumerate(sources.items())]
        catalog += [(target, c, i) for i, c in enumerate(columns)]
        for pos, (name, reads) in enumerate(columns.items()):
            items.append((s, 0, pos, name, None, reads))
            for i, ref in enumerate(reads.split()):
                qualifier, _, column = ref.rpartition(".")
                refs.append((s, 0, pos, i, qualifier or None, column))
    frame = spark.createDataFrame
    found = lineage.column_lineage(
        frame(items, "stmt_id int, branch int, pos int, alias string, column_name string, expr string"), frame(refs, "stmt_id int, branch int, pos int, ref_pos int, qualifier string, column_name string"),
        frame(tables, "stmt_id int, branch int, from_pos int, alias string, table_name string"), frame(catalog, "table_name string, column_name string, ordinal int"),
    )
    names = frame([(s, t) for s, (t, _, _) in enumerate(statements)], "stmt_id int, t string")
    edges = found.join(names, "stmt_id").select(F.concat_ws(".", "t", "target").alias("target"), F.explode(F.split("sources", ",")).alias("source")).filter("source <> ''")
    out: dict[str, dict[str, set]] = {}
    for r in lineage.to_base(edges).collect():
        table, _, column = r.target.rpartition(".")
        out.setdefault(table, {}).setdefault(column, set()).add(r.source)
    return out


def test_batch_pipeline(spark):
    found = base_columns(spark, BATCH)
    assert {t: {c: " ".join(sorted(s)) for c, s in found[t].items()} for t in BATCH_WANTED} == BATCH_WANTED


def test_streaming_pipeline(spark):
    found = base_columns(spark, STREAM)
    assert {t: {c: " ".join(sorted(s)) for c, s in found[t].items()} for t in STREAM_WANTED} == STREAM_WANTED


def text_of(target, sources, columns):
    """A statement that writes these columns: each read inside a call with a string that looks like code, in CASE or OVER by turns."""
    forms = ("COALESCE({}, 'x, (y')", "CASE WHEN {} > 1 THEN 1 END", "ROW_NUMBER() OVER (ORDER BY {})", "{}")
    outputs = []
    for i, (name, reads) in enumerate(columns.items()):
        reads = reads.split()
        body = forms[i % 4].format(f"CONCAT({', '.join(reads)})" if len(reads) > 1 else reads[0]) if reads else "'none'"
        outputs.append(f"{body} AS {name}")
    tables = " JOIN ".join(t if t == a else f"{t} AS {a}" for a, t in sources.items())
    return f"INSERT INTO {target} SELECT {', '.join(outputs)} FROM {tables}"


def base_columns_of_text(spark, statements):
    rows = spark.createDataFrame([(s, text_of(*x)) for s, x in enumerate(statements)], "stmt int, sql string")
    found, errors = selects.text_lineage(rows, "stmt", spark.createDataFrame([], "table_name string, column_name string, ordinal int"))
    assert not errors.count()
    out: dict[str, dict[str, set]] = {}
    for r in selects.base_lineage(found).collect():
        table, _, column = r.target.rpartition(".")
        out.setdefault(table, {}).setdefault(column, set()).add(r.source)
    return out


def test_pipelines_from_text(spark):
    for statements, wanted in ((BATCH, BATCH_WANTED), (STREAM, STREAM_WANTED)):
        found = base_columns_of_text(spark, statements)
        assert {t: {c: " ".join(sorted(s)) for c, s in found[t].items()} for t in wanted} == wanted
