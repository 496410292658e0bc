"""Registered queries of this package: the operators over whole given tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm import (
    chat_layouts,
    divergence_rules,
    jump_shards,
    kmeans_tree,
    licence_sentences,
    line_index,
    odd_minhash,
    periodic_runs,
    prefix_trie,
    rank_queue_bpe,
    soft_mixing,
    token_transducer,
    url_vocabulary,
)
from sluicegate.llm.settings import (
    COUNTED_VOCABULARY,
    ENCODED_VOCABULARY,
    MIXTURE_ANCHOR,
    MIXTURE_EPOCHS,
    MIXTURE_WEIGHTS,
    PAGE_RULES,
    PATTERN,
    SHARDS,
    TOKEN_LIMIT,
    labelled_domains,
)
from sluicegate.llm.tables import Staging, table


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain, rate and copies in a mixture of set weights."""
    documents = table(spark, sf_dir, "documents")
    labelled = labelled_domains(spark, sf_dir)
    mixture = soft_mixing.fit_mixture(
        documents, labelled, MIXTURE_WEIGHTS, MIXTURE_ANCHOR, MIXTURE_EPOCHS, keep_fitted=True
    )
    return soft_mixing.fitted_rates(mixture)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    counted = token_transducer.count_tokens(table(spark, sf_dir, "documents"), COUNTED_VOCABULARY)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one with control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    turns = [F.struct(F.lit(role).alias("role"), F.lit(said).alias("content")) for role in ("user", "assistant")]
    planted = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.array(*turns).alias("messages"))
    chats = chat_layouts.format_chats(rows).unionByName(chat_layouts.format_chats(planted))
    read = chats.select(
        "key",
        "formatted",
        chat_layouts.read_turns(F.col("formatted")).alias("turns"),
        chat_layouts.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("key").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


# What is read back has to be the table itself; formatted_chars adds the marks (27 code points
# a turn) and one backslash for each escaped place.
OP3_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, if(i = 0, 'user', 'assistant'), '</s>[INST] ok [/INST]' from range(2) t(i)
), marked as (
  select *, 27 + length(replace(role || text, '\', '\\'))
    + len(regexp_extract_all(replace(replace(role || chr(1) || text, '\', chr(2)), '<<', '<' || chr(3) || '<'),
      '[<\[](\||/|s>|INST\]|' || chr(3) || '<SYS>>)')) as chars from turns
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from marked group by conv_id
"""


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every hundredth id."""
    embeddings = table(spark, sf_dir, "embeddings")
    return kmeans_tree.nearest_neighbours(embeddings, "vec_id % 100 = 0")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return divergence_rules.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


OP5_SQL = rf"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), base as (
  select row_number() over () as id, *, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    len(regexp_extract_all(t, '\p{{Lu}}')) as c1, len(regexp_extract_all(t, '\p{{Nd}}')) as c2,
    len(regexp_extract_all(t, '{divergence_rules.SYMBOLS}')) as c3,
    len(regexp_extract_all(t, '[.,;:!?''"()\-]')) as c4,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs
), classes as (
  select id, lang, n_words, unnest([c1, c2, c3, c4, greatest(0, word_chars - c1 - c2 - c3 - c4)]) as n,
    unnest(range(5)) as k, greatest(word_chars, 1) as total from base
), lang_words as (
  select lang, sum(n_words) as n_words, greatest(sum(word_chars), 1) as chars from base group by lang
  having sum(n_words) >= {divergence_rules.MIN_REFERENCE_WORDS}
), lang_classes as (
  select lang, k, n / chars as q from lang_words join
    (select lang, unnest([c1, c2, c3, c4, greatest(0::hugeint, chars - c1 - c2 - c3 - c4)]) as n, unnest(range(5)) as k
      from (select lang, sum(c1) c1, sum(c2) c2, sum(c3) c3, sum(c4) c4, sum(word_chars) chars from base group by lang))
    using (lang)
), tokens as (select id, lang, unnest(w) as word from base
), common as (
  select * from (select lang, word, count(*) as n, row_number() over (partition by lang order by count(*) desc, word) as k
    from tokens where length(word) <= {divergence_rules.COMMON_CHARS} group by lang, word)
  where k <= {divergence_rules.COMMON_WORDS}
), word_q as (
  select lang, k, n / n_words as q from common join lang_words using (lang)
  union all
  select lang, 0, (any_value(n_words) - sum(n)) / any_value(n_words) from common join lang_words using (lang) group by lang
), own as (select t.id, c.k, count(*) as n from tokens t join common c on c.lang = t.lang and c.word = t.word group by t.id, c.k
), all_own as (select * from own union all
  select b.id, 0, b.n_words - coalesce(sum(o.n), 0) from base b left join own o on o.id = b.id group by b.id, b.n_words
), pairs as (
  select id, 'c' as kind, c.n / c.total as p, q.q from classes c join lang_classes q using (lang, k)
  union all
  select b.id, 'w', coalesce(o.n, 0) / greatest(b.n_words, 1), q.q from base b join word_q q using (lang)
    left join all_own o on o.id = b.id and o.k = q.k
), distance as (
  select id, kind, sum((case when p > 0 then p * log2(2 * p / (p + q)) else 0 end
    + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2) as d from pairs group by id, kind
), windows as (
  select id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as win
  from (select id, w, unnest(range(1, len(w) - 1)) as i from base)
), again as (select id, i from (select id, i, count(*) over (partition by id, win) as n from windows) where n > 1
), covered as (select id, count(distinct i + j) as n from again, range(3) r(j) group by id
), judged as (
  select doc_id, n_words, word_chars, c3, len(lines) - len(list_distinct(lines)) as dup, coalesce(v.n, 0) as rep,
    n_words < {divergence_rules.MIN_BASE_WORDS} or
      100 * coalesce(v.n, 0) > {divergence_rules.MAX_REPEATED_PERCENT} * n_words as failed,
    n_words >= {divergence_rules.MIN_WORDS} and (
      coalesce(dc.d > {divergence_rules.CLASS_LIMIT} + {divergence_rules.CLASS_SLACK} / greatest(n_words, 1), false) or
      coalesce(dw.d > {divergence_rules.WORD_LIMIT} + {divergence_rules.WORD_SLACK} / greatest(n_words, 1), false)) as far
  from base left join covered v using (id) left join distance dc on dc.id = base.id and dc.kind = 'c'
    left join distance dw on dw.id = base.id and dw.kind = 'w'
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, c3::bigint as n_symbols,
  dup::bigint as n_dup_lines, rep::bigint as n_repeat_words, failed as base_failed, not failed and not far as kept
from judged
"""


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that each document states, joined by commas."""
    found = licence_sentences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_known")


def _op6_sql() -> str:
    known = ", ".join(f"({n}, '{s}')" for s, n in licence_sentences.known_sentences().items())
    rules = ", ".join(
        f"('{r.licence}', '{licence_sentences.rule_pattern(r)}')" for r in licence_sentences.RULES
    )
    return rf"""
    with known(n, s) as (values {known}), rules(licence, pattern) as (values {rules}),
    marked as (select row_number() over () as id, doc_id, regexp_replace(lower(regexp_replace(coalesce(text, ''),
      '([.!?:;][''")]*)[ 	

]+', '' || chr(1), 'g')), '[^a-z0-9
]+', ' ', 'g') as t from documents),
    pieces as (
      select id, 'line' as how, unnest(regexp_split_to_array(t, '[
]')) as s, generate_subscripts(regexp_split_to_array(t, '[
]'), 1) as i from marked
      union all
      select id, 'block', unnest(string_split(b, chr(1))), generate_subscripts(string_split(b, chr(1)), 1) from (
        select id, regexp_replace(regexp_replace(t, '
(?: ?
)+', chr(1), 'g'), ' ?
 ?', ' ', 'g') as b from marked)
    ),
    numbered as (select id, how, i, coalesce(n, 0) as n from (select id, how, i, trim(s, ' ') as s from pieces)
      left join known using (s) where s <> ''),
    sequences as (select id, how, string_agg(' ' || n || ' ', '' order by i) as seq,
      count(*) filter (n > 0 and how = 'line') as known_lines from numbered group by id, how),
    found as (select id, string_agg(distinct licence, ',' order by licence) as licences
      from sequences join rules on regexp_matches(seq, pattern) group by id)
    select doc_id, coalesce(licences, '') as licences, coalesce(known_lines, 0)::bigint as n_known
    from marked left join found using (id) left join (select id, known_lines from sequences where how = 'line') using (id)
    """


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    judged = url_vocabulary.judge_urls(table(spark, sf_dir, "pages"), PAGE_RULES)
    return judged.select(
        "page_id", "host", "path", "rule", "verdict", "strict_hits", F.size("soft_terms").alias("soft_hits")
    )


def _op7_sql() -> str:
    """Terms by regular expression, rules by a join."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in PAGE_RULES)

    def count(terms: tuple[str, ...], how: str) -> str:
        # A boundary is shared by neighbouring hits, so it is doubled before counting.
        text = "'.' || regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g') || '.'"
        each = [f"len(regexp_extract_all({text}, '[^a-z0-9]{t}[^a-z0-9]'))" for t in terms]
        return " + ".join(e if how == "all" else f"({e} > 0)::int" for e in each)

    soft = tuple(t for t in url_vocabulary.SOFT if t not in url_vocabulary.STRICT)
    return f"""
    with rules(said, h, p) as (values {rules}),
    cut as (select page_id, translate(coalesce(url, ''), '{url_vocabulary.UPPER}', '{url_vocabulary.LOWER}') as low,
      case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    parsed as (select page_id, low,
      translate(regexp_extract(rest, '^[^/?#]*'), '{url_vocabulary.UPPER}', '{url_vocabulary.LOWER}') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
    counted as (select page_id, host, path, {count(url_vocabulary.STRICT, "all")} as strict_hits,
      {count(soft, "different")} as soft_hits from parsed),
    best as (select *, (select max(len(h || p)) from rules
      where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as size from counted)
    select page_id, host, path, h || p as rule,
      coalesce(said, case when strict_hits > 0 or soft_hits >= {url_vocabulary.MIN_SOFT} then 'block' else 'allow' end)
        as verdict,
      strict_hits::int as strict_hits, soft_hits::int as soft_hits
    from best left join rules on len(h || p) = size and (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
    """


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, digested, decoded again and digested."""
    documents = table(spark, sf_dir, "documents")
    encoded = rank_queue_bpe.encode_texts(documents, ENCODED_VOCABULARY, PATTERN)
    digested = encoded.withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = rank_queue_bpe.decode_ids(digested, ENCODED_VOCABULARY, PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 24 and its slot there, and its shard among 25."""
    return jump_shards.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op10_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and the component of its near-duplicates."""
    return odd_minhash.near_duplicates(table(spark, sf_dir, "documents"))


# Every pair that shares a shingle is compared, then links are followed from every document.
OP10_SQL = rf"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_vocabulary.UPPER}', '{url_vocabulary.LOWER}'),
    '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0)
), sizes as (select doc_id, count(*) as n from sets group by doc_id
), common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select x, y from common join sizes nx on nx.doc_id = x join sizes ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)
), edges as (select x, y from links union all select y, x from links
), reach(start, node) as (
  select distinct x, x from edges union select start, y from reach join edges on node = x
), found as (select start, min(node) as least from reach group by start)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(least, d.doc_id) as component_id,
  d.doc_id = coalesce(least, d.doc_id) as kept
from docs d left join sizes using (doc_id) left join found on start = d.doc_id
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every text, of which one in ten is rewritten to repeat itself to its end."""
    body = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(body, F.lit(prefix_trie.WORDS), 0)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, words[a + (i - a) % p]).otherwise(w)), " ")

    picked = (h % 10 == 0) & F.regexp_like(body, F.lit(prefix_trie.WORDS))
    documents = table(spark, sf_dir, "documents").select("doc_id", F.when(picked, words).alias("words"), "text")
    rewritten = documents.select("doc_id", F.when(F.col("words").isNotNull(), repeated(F.col("words"))).otherwise(F.col("text")).alias("text"))
    longest = F.array_sort(
        "runs",
        lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], -1)
        .when(x["length"] * y["period"] < y["length"] * x["period"], 1)
        .when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int"))
        .otherwise(F.signum(x["period"] - y["period"]).cast("int")),
    )
    found = periodic_runs.find_runs(rewritten).withColumn("best", F.try_element_at(longest, F.lit(1)))
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the long lines that it shares with many."""
    cleaned = line_index.drop_common_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = rf"""
with lines as (
  select row_number() over () as id, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), keyed as (
  select id, doc_id, i, lines[i] as line, translate(regexp_replace(lines[i], '^[ 	-]+|[ 	-]+$', '', 'g'),
    '{url_vocabulary.UPPER}', '{url_vocabulary.LOWER}') as key
  from (select id, doc_id, lines, unnest(range(1, len(lines) + 1)) as i from lines)
), common as (
  select key, max(doc_id) as largest from keyed where length(key) >= {line_index.MIN_CHARS}
  group by key having count(distinct id) >= {line_index.MIN_DOCS}
), marked as (select id, doc_id, i, line, largest is not null and doc_id <> largest as gone from keyed left join common using (key))
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by id
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with its first turns borrowed from another one."""
    own = Staging(spark, "turns").keep(prefix_trie.conversation_turns(table(spark, sf_dir, "conversations")), "turns")
    lenders = own.select(F.col("conv_id").alias("lender"), F.slice("turns", 1, 3).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    borrowed = F.coalesce(F.slice("lent", F.lit(1), h), F.slice("turns", 1, 0))
    rebuilt = own.join(lenders, F.col("conv_id") - F.col("conv_id") % 20 == F.col("lender"), "left").select(
        "conv_id", F.concat(borrowed, F.slice("turns", h + 1, F.size("turns"))).alias("turns")
    )
    return prefix_trie.prefix_trie(rebuilt)


# CRC-32 of the decimal id is worked out bit by bit; a node is known by the digest of its turns.
OP13_SQL = r"""
with recursive said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), numbered as (
  select conv_id, md5(length(role) || ':' || role || text) as mark, len(regexp_extract_all(text, '[^ 	-]+')) as tokens,
    row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text)) as i from said
), codes as (
  select conv_id, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint) as bytes from (select distinct conv_id from said)
), bits as (
  select conv_id, bytes, 4294967295::bigint as crc, 0 as done from codes
  union all
  select conv_id, bytes, (with recursive r(k, x) as (select 0, xor(b.crc, b.bytes[b.done + 1]) union all
    select k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end from r where k < 8)
    select x from r where k = 8), done + 1 from bits b where done < len(bytes)
), heads as (select conv_id, xor(crc, 4294967295::bigint) % 4 as h from bits where done = len(bytes)
), rebuilt as (
  select h.conv_id, n.i, n.mark, n.tokens from heads h join numbered n on n.conv_id = h.conv_id - h.conv_id % 20 and n.i <= h.h
  union all
  select h.conv_id, n.i + 1000000, n.mark, n.tokens from heads h join numbered n on n.conv_id = h.conv_id and n.i > h.h
), placed as (select conv_id, mark, tokens, row_number() over (partition by conv_id order by i) as d from rebuilt
), nodes as (
  select conv_id, d, tokens, md5(string_agg(mark, '') over (partition by conv_id order by d)) as node,
    coalesce(md5(string_agg(mark, '') over (partition by conv_id order by d rows between unbounded preceding and 1 preceding)), 'root') as parent
  from placed
  union all select conv_id, 0, 0, 'root', null from heads
), sizes as (select conv_id, max(d) as size from nodes group by conv_id
), grouped as (
  select node, any_value(d) as d, any_value(parent) as parent, any_value(tokens) as tokens, min(conv_id) as least, count(*) as n,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (d = size) as ended
  from nodes join sizes using (conv_id) group by node
), families as (select parent as node, count(*) as n_children from grouped where parent is not null group by parent
), below as (select distinct a.node as top, b.node from nodes a join nodes b on a.conv_id = b.conv_id and b.d >= a.d
), sums as (
  select top as node, count(*) filter (n_children is null) as n_leaves, sum((n - 1) * tokens) as saved
  from below join grouped g on g.node = below.node left join families f on f.node = below.node group by top
)
select g.least as conv_id, g.d::bigint as depth, p.least as parent_conv_id, g.n::bigint as n_convs,
  coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens,
  sha256(coalesce(g.ended, '')) as ends_sha256
from grouped g join sums s on s.node = g.node left join families f on f.node = g.node left join grouped p on p.node = g.parent
"""


QUERIES = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_kmeans_tree": op4_kmeans_tree,
    "op5_quality_rules": op5_quality_rules,
    "op6_licence_scan": op6_licence_scan,
    "op7_url_filter": op7_url_filter,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_jump_sharding": op9_jump_sharding,
    "op10_odd_minhash": op10_odd_minhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_index": op12_line_index,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_chat_formatting": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_licence_scan": _op6_sql(),
    "op7_url_filter": _op7_sql(),
    "op10_odd_minhash": OP10_SQL,
    "op12_line_index": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
