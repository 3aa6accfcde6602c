"""The operators applied to the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.llm import (
    alignment,
    chat,
    decontaminate,
    language,
    main_text,
    mixing,
    ngram_join,
    quality,
    spelling,
    substrings,
    token_files,
    toxicity,
    urls,
)
from tallywatch.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    out = language.held_out(F.col("doc_id"), 5, 0)
    model = language.fit(documents.filter(~out))
    found = language.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op2_main_text")
def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return main_text.extract_main_text(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars")
    )


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    out = language.held_out(F.col("doc_id"), 3, 1)
    labels = (
        table(spark, folder, "labels")
        .filter(~out)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    marked = documents.withColumn("mark", F.xxhash64("text"))
    model = toxicity.fit(marked.join(labels, "doc_id"), mark="mark")
    scored = toxicity.score(documents, model)
    return scored.select(
        "doc_id",
        out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "spans",
    )


@query("op4_url_verdicts")
def op4_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, folder, "pages"), urls.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "url")


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.concat_ws(",", "broken").alias("broken"),
    )


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    done = decontaminate.decontaminate(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    return done.select(
        "doc_id",
        (F.size("leaks") > 0).alias("leaked"),
        # As text, which all engines write alike.
        F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"),
        F.array_join(F.transform("leaks", lambda x: x["first"].cast("string")), ",").alias("first_words"),
    )


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, folder, "documents")).drop("mark", "class_key")


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    done = substrings.dedup_substrings(documents.select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r["words"])
    return done.select("doc_id", "text", n_removed.alias("n_removed"), "removed")


@query("op9_mix_sources")
def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_chat_format")
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"select -1L as conv_id, * from values (0L, 'user', '{said}'), (1L, 'assistant', '{said}')"
        " as t(turn, role, text)"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_chats(rows.unionByName(extra)))


@query("op11_align_tokenizers")
def op11_align_tokenizers(spark: SparkSession, folder: str) -> DataFrame:
    aligned = alignment.align_tokenizers(
        table(spark, folder, "documents"),
        token_files.default_tokenizer("byte_bpe_50k.json"),
        token_files.default_tokenizer("piece_bpe_32k.model"),
    )
    return aligned.select(F.col("doc_id").cast("bigint").alias("doc_id"), *aligned.columns[1:])


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op13_token_files")
def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as the files have them; id 2 ends each."""
    path = scratch_path(spark, "token-files")
    tokenizer = token_files.default_tokenizer("word_bpe_49k.json")
    token_files.write_token_files(table(spark, folder, "documents"), tokenizer, path, end_id=2)
    return token_files.read_documents(spark, path)


# The words of a text, as DuckDB says it.
WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE["op10_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|INST\]|/INST\]|NEXT\]|/s>)', '\1\\\2\3', 'g') AS safe,
    regexp_replace(role, '([<\[])(\\*)(s>|INST\]|/INST\]|NEXT\]|/s>)', '\1\\\2\3', 'g') AS safe_role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS starts
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(3 + sum(length(safe) + CASE WHEN starts THEN 6 + length(safe_role) + 7 + 4 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
ORACLE["op4_url_verdicts"] = r"""
WITH RECURSIVE rules(rhost, rpath, rverdict) AS (VALUES RULES),
pages0 AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest
  FROM pages
), tags AS (
  SELECT host || rest AS address, url, host, path,
    unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag
  FROM pages0 WHERE instr(url, '://') > 0
), attributes AS (
  SELECT *, ATTR(rel) AS rel, ATTR(href) AS href, ATTR(http-equiv) AS equiv, ATTR(content) AS content FROM tags
), targets AS (
  SELECT address, url, host, path, replace(trim(CASE
    WHEN regexp_matches(rel, '(?i)(^|\s)canonical(\s|$)') THEN href
    WHEN lower(trim(equiv)) = 'refresh' THEN regexp_extract(content, '(?is)^[\s\d.]*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1)
    ELSE '' END), '&amp;', '&') AS link FROM attributes
), resolved AS (
  SELECT address, CASE
    WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*://') THEN link
    WHEN link LIKE '//%' THEN split_part(url, '://', 1) || ':' || link
    WHEN link LIKE '/%' THEN split_part(url, '://', 1) || '://' || host || link
    WHEN link LIKE '?%' THEN split_part(url, '://', 1) || '://' || host || path || link
    ELSE split_part(url, '://', 1) || '://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || link END AS "to"
  FROM targets WHERE link <> ''
), linked AS (
  SELECT address, translate(regexp_extract("to", '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract("to", '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract("to", '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest
  FROM resolved WHERE instr("to", '://') > 0
), named AS (
  SELECT host, path, host || rest AS address FROM pages0 WHERE instr(url, '://') > 0
  UNION SELECT host, path, host || rest FROM linked
), ruled AS (
  SELECT address, host, path, rhost || rpath AS rule, rverdict FROM named JOIN rules
    ON host <> '' AND (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY address, host, path ORDER BY length(rhost || rpath) DESC, rverdict) = 1
), edges AS (
  SELECT address AS u, host || rest AS v FROM linked UNION SELECT host || rest, address FROM linked
), reached AS (
  SELECT address AS node, rverdict AS verdict FROM ruled
  UNION SELECT v, verdict FROM reached JOIN edges ON node = u
), told AS (SELECT node, min(verdict) AS inherited FROM reached GROUP BY node)
SELECT page_id, p.host, p.path, rule, coalesce(rverdict, inherited, 'allow') AS verdict, url
FROM pages0 p LEFT JOIN ruled ON address = p.host || p.rest AND ruled.host = p.host AND ruled.path = p.path
  LEFT JOIN told ON node = p.host || p.rest
""".replace("RULES", _RULES, 1)
for _name in ("rel", "href", "http-equiv", "content"):
    _pattern = rf"(?is)[\s\"''/]{_name}\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s\"''>]+))".replace("\\\"", '"')
    ORACLE["op4_url_verdicts"] = ORACLE["op4_url_verdicts"].replace(
        f"ATTR({_name})", " || ".join(f"regexp_extract(tag, '{_pattern}', {i})" for i in (1, 2, 3))
    )

_RISK = quality.Risk()
_GRID = ", ".join(
    f"('{rule}', {cut}, {i})"
    for i, (rule, (_, grid)) in enumerate(quality.RULES.items())
    for cut in grid
)
_MEASURES = ", ".join(f"CAST({value} AS DOUBLE)" for value, _ in quality.RULES.values())
ORACLE["op5_quality_rules"] = f"""
WITH split AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS body, {WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT row_id, w, list(p) AS ps FROM (
    SELECT row_id, unnest(range(1, len(ws) - 1)) AS p, [ws[p], ws[p + 1], ws[p + 2]] AS w FROM split WHERE len(ws) >= 3)
  GROUP BY row_id, w HAVING count(*) > 1
), repeats AS (
  SELECT row_id, count(DISTINCT p + d) AS n FROM (SELECT row_id, unnest(ps) AS p FROM windows), range(3) AS r(d) GROUP BY row_id
), counted AS (
  SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_append(ws, ''), 'string_agg', '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (row_id)
), based AS (
  SELECT *, n_words < {_RISK.min_words} OR 100 * n_repeat_words > {_RISK.max_repeat} * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN [{_MEASURES}] END AS ms FROM counted
), good AS (SELECT doc_id AS good_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1),
grid(rule, cutoff, i) AS (VALUES {_GRID}),
tests AS (
  SELECT lang, rule, CAST(cutoff AS DOUBLE) AS cutoff, i, count(*) AS n, count(*) FILTER (ms[i + 1] > cutoff) AS k
  FROM based JOIN good ON doc_id = good_id, grid WHERE NOT base_failed GROUP BY ALL
), tails AS (
  SELECT *, count(*) OVER () AS tests, CASE WHEN k >= n * {_RISK.risk / len(quality.RULES)} THEN 1 ELSE
    list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
      + j * ln({_RISK.risk / len(quality.RULES)}) + (n - j) * ln(1 - {_RISK.risk / len(quality.RULES)})))) END AS tail
  FROM tests
), runs AS (
  SELECT *, bool_and(tail <= {_RISK.error} / tests) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS safe FROM tails
), chosen AS (SELECT lang AS of_lang, rule, i, min(cutoff) AS cutoff FROM runs WHERE safe GROUP BY ALL),
per AS (SELECT of_lang, list(struct_pack(i := i, rule := rule, cutoff := cutoff) ORDER BY i) AS cuts FROM chosen GROUP BY of_lang),
judged AS (
  SELECT *, CASE WHEN n_words > 0 THEN list_filter(coalesce(cuts, []), lambda c: ms[c.i + 1] > c.cutoff) ELSE [] END AS hits
  FROM based LEFT JOIN per ON lang IS NOT DISTINCT FROM of_lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(hits) = 0 AS kept,
  coalesce(list_aggregate(list_transform(hits, lambda c: c.rule), 'string_agg', ','), '') AS broken FROM judged
"""

_MIX = mixing.Mix()
_VARIANTS = spelling.Variants()


def _draw(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)})"


def _apportion(entries: str, group: str, order: str) -> str:
    """The Sainte-Lague seats of ``entries`` by plainly ranking every quotient up to ``most``."""
    return f"""(SELECT * EXCLUDE (j, place), count(*) FILTER (j IS NOT NULL AND place <= seats) AS quota FROM (
      SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY votes / (2 * j + 1) DESC NULLS LAST, {order}, j) AS place
      FROM (SELECT *, unnest(list_prepend(NULL, CASE WHEN votes > 0 THEN range(0, most) ELSE [] END)) AS j FROM {entries}))
      GROUP BY ALL)"""


ORACLE["op9_mix_sources"] = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(text, '')) AS mark FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([{', '.join(map(str, _MIX.weights))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(_MIX.weights)} + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), rated AS (SELECT *, source_size * {float(_MIX.cap)} AS room, source_size * {float(_MIX.cap)} / weight AS ratio FROM totals),
leveled AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () * {_MIX.total} - coalesce(sum(room) OVER (
      ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM rated
), goal AS (
  SELECT source, source_size, least(room, weight * coalesce(max(level) FILTER (level <= ratio) OVER (), 1e300)) AS target FROM leveled
), dealt AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY doc_id NULLS FIRST, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT sized.*, CAST(floor({_draw(str(_MIX.seed), "'shard'", "coalesce(CAST(doc_id AS VARCHAR), 'null')", 'mark')} * greatest(ceil(source_size / {float(_MIX.shard_words)}), 1)) AS BIGINT) AS shard
    FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source WHERE size > 0)
), parts AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, CAST(greatest(floor(sum(size) / {float(_MIX.block_words)} + 0.5), 1) AS BIGINT) AS blocks
  FROM dealt GROUP BY source, shard
), sources AS (
  SELECT g.source, any_value(target) AS votes, CAST(sum(blocks) * {_MIX.cap} AS BIGINT) AS most, 1 AS one
  FROM goal g JOIN parts p ON g.source IS NOT DISTINCT FROM p.source GROUP BY g.source
), seated AS (SELECT *, CAST(floor(sum(votes) OVER () / {float(_MIX.block_words)} + 0.5) AS BIGINT) AS seats FROM sources),
quotas AS (SELECT source, quota AS seats FROM {_apportion('seated', 'one', 'source NULLS LAST')}),
voted AS (
  SELECT p.*, seats, shard_size::DOUBLE AS votes, CAST(blocks * {_MIX.cap} AS BIGINT) AS most
  FROM parts p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source
), per_shard AS (SELECT source, shard, shard_size, blocks, quota FROM {_apportion('voted', 'source', 'shard')}),
drawn AS (SELECT *, unnest(range(0, blocks)) AS block FROM per_shard),
times AS (
  SELECT source, shard, block * shard_size // blocks AS low, (block + 1) * shard_size // blocks AS high,
    quota // blocks + CASE WHEN row_number() OVER (PARTITION BY source, shard ORDER BY {_draw(str(_MIX.seed), "'block'", "coalesce('=' || source, 'null')", 'shard', 'block')}, block) <= quota % blocks THEN 1 ELSE 0 END AS times
  FROM drawn
), met AS (
  SELECT d.doc_id, d.source, d.shard, d.start, d.size, coalesce(sum(times * (least(start + size, high) - greatest(start, low))), 0) AS taken
  FROM dealt d LEFT JOIN times t ON d.source IS NOT DISTINCT FROM t.source AND d.shard = t.shard AND low < start + size AND high > start
  GROUP BY ALL
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM (
  SELECT doc_id, source, size, taken FROM met UNION ALL SELECT doc_id, source, size, 0 FROM sized WHERE size = 0) m
JOIN goal g ON m.source IS NOT DISTINCT FROM g.source
"""


# Every pair that shares an n-gram, by the n-grams; classes by the links they make.
ORACLE["op7_ngram_join"] = f"""
WITH RECURSIVE split AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
grams AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM split
), classes AS (
  SELECT g, row_number() OVER () AS c, min(doc_id) AS copy_id, count(*) AS copies, len(g) AS n FROM grams WHERE len(g) > 0 GROUP BY g
), flat AS (SELECT c, copies, n, unnest(g) AS x FROM classes),
links AS (
  SELECT a.c AS a, b.c AS b, any_value(b.copies) AS copies FROM flat a JOIN flat b ON a.x = b.x AND a.c <> b.c
  GROUP BY a.c, b.c HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
  SELECT c, copy_id FROM classes UNION SELECT b, copy_id FROM reached JOIN links ON c = a
), named AS (SELECT c, min(copy_id) AS class_id FROM reached GROUP BY c),
counted AS (SELECT a, sum(copies) AS n_links, count(*) AS n_set_links FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copy_id, doc_id) AS copy_id, coalesce(copies, 1) AS n_copies,
  CAST(len(grams.g) AS BIGINT) AS n_grams, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(n_set_links, 0) AS n_set_links
FROM grams LEFT JOIN classes ON grams.g = classes.g LEFT JOIN named USING (c) LEFT JOIN counted ON c = a
"""


# Every window of a document that shares a shingle with an item of its size, compared plainly.
ORACLE["op6_decontaminate"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text IS NULL AS missing, {WORDS} AS ws FROM documents),
items AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
item AS (SELECT item_id, len(ws) AS n, least(len(ws), 5) AS size, ws FROM items WHERE len(ws) > 0),
item_bag AS (
  SELECT item_id, n, size, ws[i:i + size - 1] AS g, count(*) AS c
  FROM (SELECT *, unnest(range(1, n - size + 2)) AS i FROM item) GROUP BY ALL
), doc_grams AS (
  SELECT r, len(ws) AS n_doc, size, p, ws[p:p + size - 1] AS g
  FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS p FROM docs, (SELECT DISTINCT size FROM item) WHERE len(ws) >= size)
), shared AS (SELECT DISTINCT r, n_doc, d.p, i.size, n, item_id FROM doc_grams d JOIN item_bag i ON d.g = i.g AND d.size = i.size),
starts AS (
  SELECT DISTINCT r, n_doc, size, n, item_id, s FROM (
    SELECT *, unnest(range(greatest(1, p - (n - size)), least(p, greatest(n_doc - n + 1, 1)) + 1)) AS s FROM shared)
), bags AS (
  SELECT w.r, w.item_id, w.n, w.size, w.s, g, count(*) AS c FROM starts w JOIN doc_grams d
    ON w.r = d.r AND w.size = d.size AND d.p >= w.s AND d.p <= w.s + w.n - w.size GROUP BY ALL
), compared AS (
  SELECT b.r, b.item_id, b.s, sum(b.c) AS own, sum(least(b.c, coalesce(i.c, 0))) AS common, any_value(b.n - b.size + 1) AS other
  FROM bags b LEFT JOIN item_bag i ON b.item_id = i.item_id AND b.g = i.g GROUP BY b.r, b.item_id, b.s
), best AS (
  SELECT r, item_id, arg_max(s, (common / (own + other - common), -s)) AS s
  FROM compared WHERE common / (own + other - common) >= 0.8 GROUP BY r, item_id
), leaks AS (SELECT r, list(item_id ORDER BY item_id) AS item_ids, list(s - 1 ORDER BY item_id) AS first_words FROM best GROUP BY r)
SELECT doc_id, item_ids IS NOT NULL AS leaked, coalesce(array_to_string(item_ids, ','), '') AS item_ids,
  coalesce(array_to_string(first_words, ','), '') AS first_words
FROM docs LEFT JOIN leaks USING (r)
"""


# CRC-32 by its table, then near words by plainly leaving out each letter.
ORACLE["op12_spelling_variants"] = f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(0, 256) r(i))
), runs AS (
  SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{spelling.RUN}')) AS run FROM documents)
), grouped AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
  FROM runs WHERE length(run) >= {_VARIANTS.length} GROUP BY doc_id, run
), drawn AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM grouped, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % {_VARIANTS.thinned} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM drawn)
  WHERE length(word) >= {_VARIANTS.length} GROUP BY word HAVING sum(n) >= {_VARIANTS.times}
), cuts AS (
  SELECT word, left(word, i) || '*' || substr(word, i + 2) AS pattern, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.pattern = b.pattern AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word
), counted AS (
  SELECT a, count(*) AS n_near, arg_min(struct_pack(b := b, n := n), struct_pack(m := -n, b := b)) AS best
  FROM near JOIN words ON b = word GROUP BY a
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= {_VARIANTS.ratio} * n THEN best.b END AS form,
    CASE WHEN best.n >= {_VARIANTS.ratio} * n THEN best.n END AS form_n
  FROM words LEFT JOIN counted ON word = a
), followed AS (
  SELECT word AS start, form AS here FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT start, form FROM followed JOIN formed ON here = word WHERE form IS NOT NULL
), ends AS (SELECT start, here FROM followed JOIN formed ON here = word WHERE form IS NULL)
SELECT word, form, coalesce(here, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends ON word = start
"""
