"""Messages, answers, hosts and call lines derived from keys, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FROM = (
    "alerts@paypal.com", "billing@paypa1-secure.com", "john.smith@gmail.com", "news@example.org", "ceo.office@outlook.com", "support@micros0ft.com",
    "amazon-refund@yahoo.com", "service@amazom.com", "info@example.co.uk", "security@mypaypal.net", None,
)
NAMES = (None, "PayPal", "John Smith", "Billing Department", "service@bank.example", "Amazon", "Newsletter", "Microsoft Support", "Jane")
REPLIES = (None, "help@gmail.com", "desk@example.org", "pay@paypai-login.com", "me@corp.example", None)
SUBJECTS = ("Hello", "URGENT INVOICE NOTICE", "Your PayPal account", "Payment receipt", "Meeting", "Win now!!", "Weekly news", "Purchase order 7", "Hi", "Re: lunch")
BODIES = (
    "Thanks for your note, see you on Monday.", "Please verify your account within 24 hours or it will be suspended.", "Buy gift cards and send me the codes, keep this between us.",
    "Kindly arrange a wire transfer to the beneficiary account today only.", "Your payroll update is ready, click here.",
    "Call our helpline on (555) 123-4567 for a refund of your renewed subscription.", "Send bitcoin to the wallet address or I release the video of you.",
    "Dear customer, please find attached invoice and pay now.", "Are you available? I am in a meeting, quick task for the CEO.", "Congratulations, you have won the lottery jackpot.",
    "Scan the QR code to continue.", "Your PayPal security code is 482913. It expires in ten minutes.", "This mail has nothing to report.",
)
HREFS = (
    None, "https://www.paypal.com/login", "http://paypa1-secure.com/verify?id=1", "https://bit.ly/abc", "http://192.168.10.9/index.html", "https://shop.example.top/a",
    "https://user@evil.example/x", "https://a.b.c.d.example.org/", "https://login.example.net/", "https://paypal.evil.example/pay", "javascript:alert(1)", "https://site.github.io/account",
)
ANCHORS = ("Click", "https://www.paypal.com/signin", "example.org", "")
SPF, DKIM, DMARC, ARC = ("pass", "fail", "softfail", "permerror", None), ("pass", "fail", "none", None), ("pass", "fail", "none", None, "pass", None), (None, "pass", "fail", None, None, None, None)
DKIM_DOMAINS = ("paypal.com", "example.org", "mailer.example")
FILES = (None, "invoice.pdf.exe", "report.pdf", "payment.html", "archive.zip", "macro.docm", "holiday.jpg", "invoice.pdf")
HOSTS = (
    "www.paypal.com", "paypa1.com", "rnicrosoft.com", "amazom.com", "mypaypal.net", "apple-id-verify.com", "apple.example.org", "netflix.account-update.co.uk", "example.org",
    "paypal-secure.myshopify.com", "gooogle.com", "10.1.2.3", "wise.example.com", "facebook2.com", "xn--pypal-4ve.com", "secure-docusign.net",
)
LINES = (
    "Hello, how are you today?", "You need to buy three Google Play gift cards and read me the numbers.", "There is a warrant for your arrest.", "Do not tell anyone about this call.",
    "Please stay on the line.", "We will never ask you for your password.", "Move your money to a safe account right now.", "The verification code we just sent, read it to me.",
    "my password is sunflower", "I was thinking of soup for dinner.", "Your computer has been infected with a virus, please install AnyDesk.", "Pick up a gift card for the birthday party.",
)

#: Most keys of a part, on average, when they are spread.
KEYS = 200_000


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def pick(values, index: str, spark: bool) -> str:
    """The value at an index from 0."""
    listed = ", ".join(map(_text, values))
    return f"element_at(array({listed}), CAST(1 + {index} AS INT))" if spark else f"list_extract([{listed}], CAST(1 + {index} AS INT))"


def messages_sql(spark: bool) -> str:
    """Flat columns of a synthetic message for each order."""
    k = "o_orderkey"
    cols = {
        "from_address": pick(FROM, f"({k} % 11)", spark), "from_name": pick(NAMES, f"({k} % 9)", spark), "reply_address": pick(REPLIES, f"({k} % 6)", spark),
        "subject": pick(SUBJECTS, f"({k} % 10)", spark), "body": pick(BODIES, f"({k} % 13)", spark), "href": pick(HREFS, f"({k} % 12)", spark), "anchor": pick(ANCHORS, f"({k} % 4)", spark),
        "spf": pick(SPF, f"({k} % 5)", spark), "dkim": pick(DKIM, f"({k} % 4)", spark), "dmarc": pick(DMARC, f"({k} % 6)", spark), "arc": pick(ARC, f"({k} % 7)", spark),
        "dkim_domain": pick(DKIM_DOMAINS, f"({k} % 3)", spark), "filename": pick(FILES, f"({k} % 8)", spark),
    }
    return f"SELECT {k} AS message_id, {k} % 5 = 0 AS is_list, {k} % 17 = 0 AS self_sent, {k} % 14 = 0 AS has_sender, " + ", ".join(f"{v} AS {n}" for n, v in cols.items()) + " FROM orders"


def _orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces are the formatter's
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """A table may be one file and so one task: its rows are spread over the cores before anything is made of them, in parts that do not grow with it."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // KEYS)), key)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat messages in the mail rules' schema."""
    keys = _spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey")
    flat = spark.sql(messages_sql(spark=True).replace("FROM orders", "FROM {orders}"), orders=keys)

    def address(a, name=None):
        return F.when(a.isNotNull(), F.struct((F.lit(None).cast("string") if name is None else name).alias("name"), a.alias("address")))

    def listed(x):
        return F.array_compact(F.array(x))

    nothing = F.lit(None).cast("string")
    return flat.select(
        F.col("message_id"), address(F.col("from_address"), F.col("from_name")).alias("from"), address(F.when(F.col("has_sender"), F.lit("bounce@list.example"))).alias("sender"),
        listed(address(F.col("reply_address"))).alias("reply_to"),
        F.array(address(F.when(F.col("self_sent"), F.col("from_address")).otherwise(F.lit("sam@corp.example")))).alias("to"),
        "subject", F.col("body").alias("text_body"), nothing.alias("html_body"),
        F.when(F.col("is_list"), F.array(F.struct(F.lit("List-Unsubscribe").alias("name"), F.lit("<x>").alias("value")))).alias("headers"),
        listed(F.when(F.col("filename").isNotNull(), F.struct(F.col("filename"), nothing.alias("mime_type"), F.lit(1).cast("bigint").alias("size_bytes")))).alias("attachments"),
        listed(F.when(F.col("href").isNotNull(), F.struct("href", "anchor"))).alias("links"),
        F.struct("spf", "dkim", "dmarc", "arc", F.when(F.col("dkim") == "pass", F.col("dkim_domain")).alias("dkim_domain"), nothing.alias("spf_domain")).alias("auth"),
    )


#: (id, severity, weight, credit, modulus): fires where the key is a multiple of the modulus.
CANDIDATES = (
    ("sender.lookalike_domain", "high", 0.55, 0.0, 3), ("auth.spf_fail", "medium", 0.3, 0.0, 2), ("content.gift_card_request", "high", 0.5, 0.0, 5),
    ("content.urgency", "medium", 0.25, 0.0, 4), ("mitigation.brand_authenticated", "info", 0.0, 0.25, 7), ("link.plain_http", "low", 0.1, 0.0, 6),
)
CATEGORIES = ("phishing", "scam", "spam", "safe")


def scored_sql(spark: bool) -> str:
    k = "o_orderkey"
    fires = ", ".join(f"{k} % {m} = 0 AS s{i}" for i, (*_, m) in enumerate(CANDIDATES))
    return f"SELECT {k} AS message_id, {fires}, CASE WHEN {k} % 8 <> 0 THEN {k} % 101 END AS risk_score, {k} % 3 <> 1 AS suspicious, {pick(CATEGORIES, f'({k} % 4)', spark)} AS model_category FROM orders"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, signals, score, risk_score, suspicious, model_category."""
    from larkspur.functions import scoring

    rows = _orders(spark, sf_dir, scored_sql(spark=True))
    every = [F.when(F.col(f"s{i}"), F.struct(F.lit(i).alias("ord"), F.lit(id_).alias("id"), F.lit(id_).alias("title"), F.lit(sev).alias("severity"), F.lit(w).alias("weight"), F.lit(c).alias("credit"))) for i, (id_, sev, w, c, _) in enumerate(CANDIDATES)]
    rows = rows.withColumn("signals", F.array_compact(F.array(*every)))
    return rows.select("message_id", "signals", F.round(scoring.heuristic_score(F.col("signals")), 6).alias("score"), "risk_score", "suspicious", "model_category")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, heuristic and members: a primary and two corroborators, some without an answer."""
    k = "o_orderkey"
    sql = f"SELECT {k} AS message_id, ({k} % 10) / 10.0D AS heuristic, CASE WHEN {k} % 9 <> 0 THEN {k} % 71 END AS a, CASE WHEN {k} % 4 <> 0 THEN {k} % 89 END AS b, {k} % 97 AS c FROM orders"
    rows = _orders(spark, sf_dir, sql)

    def member(role: str, name: str, score: str):
        return F.struct(F.lit(role).alias("role"), F.lit(name).alias("identifier"), F.col(score).alias("risk_score"))

    return rows.select("message_id", "heuristic", F.array(member("primary", "local", "a"), member("corroborator", "second", "b"), member("corroborator", "third", "c")).alias("members"))


SAID = ("Phishing", "SCAM attempt", "not spam", "spam", "unsure", "legitimate")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of a model: an object for each order, bare, fenced, among words, after thinking, cut off, or none at all; some without a score."""
    k = "o_orderkey"
    shown = f"CASE WHEN {k} % 7 <> 0 THEN concat('\"riskScore\": ', CAST({k} * 7 % 160 - 20 AS STRING), ', ') ELSE '' END"
    obj = f"concat('{{', {shown}, '\"category\": \"', {pick(SAID, f'({k} % 6)', True)}, '\", \"reasons\": [\"reason ', CAST({k} AS STRING), '\", \" \", \"- second\"]')"
    forms = (f"concat({obj}, '}}')", f"concat('```json\n', {obj}, ',}}\n```')", f"concat('My verdict: ', {obj}, '}} Stay safe.')", f"concat('<think>maybe {{}}</think>', {obj}, '}}')", obj, "'I cannot say.'")
    cases = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(forms))
    return _orders(spark, sf_dir, f"SELECT {k} AS message_id, CASE {k} DIV 6 % 6 {cases} END AS raw FROM orders")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, f"SELECT o_orderkey AS message_id, {pick(HOSTS, '(o_orderkey % 16)', True)} AS host FROM orders")


def lines_sql(spark: bool) -> str:
    """Call lines, no two alike: a customer's orders are a call, and so is a conversation; k is the place in ``LINES`` of what decides."""
    k, kind = "o_orderkey", "VARCHAR(40)" if spark else "VARCHAR"
    rows = (
        f"SELECT 'o' || CAST(o_custkey AS {kind}) AS call_id, {k} AS ord, CASE WHEN {k} % 3 = 0 THEN 'user' ELSE 'caller' END AS speaker, ({k} * 7 + o_custkey) % 12 AS k, '' AS said, "
        f"' ' || translate(CAST({k} AS {kind}), '0123456789', 'qwxzvjkpyh') AS more, {k} % 10 <> 0 AS final FROM orders "
        f"UNION ALL SELECT 'v' || CAST(conv_id AS {kind}), CAST(turn AS BIGINT), CASE WHEN role = 'user' THEN 'user' ELSE 'caller' END, (conv_id * 7 + turn) % 12, coalesce(text, '') || ' ', '', turn % 7 <> 5 FROM conversations WHERE role <> 'system'"
    )
    return f"SELECT call_id, ord, speaker, k, said || {pick(LINES, 'k', spark)} || more AS text, final FROM ({rows})"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as in messages
    tables = {t: _spread(spark.read.parquet(f"{sf_dir}/{t}.parquet"), key) for t, key in (("orders", "o_orderkey"), ("conversations", "conv_id"))}
    sql = lines_sql(spark=True).replace("{", "{{").replace("}", "}}")
    return spark.sql(sql.replace("FROM orders", "FROM {orders}").replace("FROM conversations", "FROM {conversations}"), **tables).drop("k")


STATUSES = ("connecting", "in_progress", "in_progress", "ringing", "connecting", "in_progress", "ringing", "connecting", "in_progress", "connecting", "in_progress", "completed")


def session_events_sql(spark: bool) -> str:
    """The orders of ten customers as the events of a call, a hundred or so; k is the place of a segment's line in ``LINES``."""
    k, kind = "o_orderkey", "VARCHAR(40)" if spark else "VARCHAR"
    at = "timestamp_millis({})" if spark else "make_timestamp({} * 1000)"
    said = f"({k} * 7 + o_custkey) % 12"
    return (
        f"SELECT 's' || CAST(o_custkey {'DIV' if spark else '//'} 10 AS {kind}) AS call_id, {k} AS n, {at.format(f'1700000000000 + {k} * 100')} AS at, {said} AS k, "
        f"CASE WHEN {k} % 8 = 0 THEN 'created' WHEN {k} % 8 <= 5 THEN 'segment' WHEN {k} % 8 = 6 THEN 'status' ELSE 'verdict' END AS kind, "
        f"CASE WHEN {k} % 8 BETWEEN 1 AND 5 THEN CASE WHEN {k} % 3 = 0 THEN 'user' ELSE 'caller' END END AS speaker, "
        f"CASE WHEN {k} % 8 BETWEEN 1 AND 5 THEN CASE WHEN {k} % 17 = 0 THEN '  ' ELSE {pick(LINES, said, spark)} END END AS text, "
        f"{k} % 5 <> 0 AS final, CASE WHEN {k} % 13 <> 0 THEN {k} * 7 % 50 END AS sequence, "
        f"CASE WHEN {k} % 8 = 6 THEN {pick(STATUSES, f'({k} {"DIV" if spark else "//"} 8 % 12)', spark)} END AS status, "
        f"CASE WHEN {k} % 8 = 7 THEN {k} % 101 / 100.0{'D' if spark else '::DOUBLE'} END AS score FROM orders"
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, session_events_sql(spark=True)).drop("k")


def auth_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of a message for each customer: results of the own server, of a server that is not trusted, sealed ones and Received-SPF."""
    k, results = F.col("c_custkey"), [F.lit(x) for x in ("pass", "fail", "softfail", "none", "temperror", "odd")]
    spf, dkim = F.get(F.array(*results), (k % 6).cast("int")), F.get(F.array(*results[:4]), (k % 4).cast("int"))
    own = F.concat(F.lit("mx.own.example (a; b); spf="), spf, F.lit(" smtp.mailfrom=bounce@Mail.Example; dkim="), dkim, F.lit(' header.d=other.example; dkim=pass header.d="shop.example"'), F.when(k % 3 == 0, "; dmarc=fail (p=reject) header.from=shop.example").otherwise(""))
    sealed = F.lit("i=2; mx.list.example; dmarc=pass; spf=pass smtp.helo=relay.example")
    names = F.array(F.lit("Authentication-Results"), F.lit("authentication-results"), F.lit("ARC-Authentication-Results"), F.lit("Received-SPF"))
    values = F.array(own, F.lit("evil.example; spf=pass; dmarc=pass"), sealed, F.lit("softfail (mx.own.example)"))
    first = F.when(k % 5 == 0, 2).when(k % 5 == 1, 4).otherwise(1)  # some have sealed results only, some Received-SPF only
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", F.when(first == 2, F.array(names[2])).when(first == 4, F.array(names[3])).otherwise(names).alias("names"), F.when(first == 2, F.array(values[2])).when(first == 4, F.array(values[3])).otherwise(values).alias("header_values"))


def tree_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as the JSON of a mail whose payload is a tree: address as text, markup as HTML, every third with a file, every fourth a level deeper."""
    k = F.col("page_id")
    coded = lambda t: F.rtrim(F.translate(F.base64(t.cast("binary")), "+/\r\n", "-_"), F.lit("="))
    leaf = lambda kind, t: F.concat(F.lit(f'{{"mimeType":"{kind}","body":{{"data":"'), coded(t), F.lit('"}}'))
    both = F.concat(F.lit('{"mimeType":"multipart/alternative","parts":['), leaf("text/plain", F.col("url")), F.lit(","), leaf("TEXT/HTML; charset=utf-8", F.col("html")), F.lit("]}"))
    deeper = F.when(k % 4 == 0, F.concat(F.lit('{"mimeType":"multipart/related","parts":['), both, F.lit("]}"))).otherwise(both)
    file = F.when(k % 3 == 0, F.concat(F.lit(',{"mimeType":"application/pdf","filename":"bill '), k.cast("string"), F.lit('.pdf","body":{"size":'), (k * 10).cast("string"), F.lit("}}"))).otherwise("")
    headers = F.concat(F.lit('[{"name":"FROM","value":"\\"Shop, '), k.cast("string"), F.lit('\\" <s'), k.cast("string"), F.lit('@shop.example>"},{"name":"Subject","value":" Page '), k.cast("string"), F.lit(' "}]'))
    body = F.concat(F.lit('{"id":"m'), k.cast("string"), F.lit('","internalDate":"'), (k * 1000).cast("string"), F.lit('","payload":{"mimeType":"multipart/mixed","headers":'), headers, F.lit(',"parts":['), deeper, file, F.lit("]}}"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("a").alias("account_id"), F.when(k % 11 == 10, F.substring(body, 1, 40)).otherwise(body).alias("body"))
