"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import collocations, coverdedup, extraction, langid, mixing, packing, pii, prefixtrie, secrets, sharding, simhash, topk, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False).drop("ids")
    packed = packing.pack(cut)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector, by the integer inner product."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return coverdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


MIX = ["source", "lang", "topic"]


def with_topic(docs: DataFrame) -> DataFrame:
    counted = docs.withColumn("tokens", mixing.word_tokens(docs["text"]))
    return counted.withColumn("topic", mixing.form_topic(F.col("tokens")))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability and draw in a mix of half the tokens, evened out over source, language and
    topic."""
    docs = with_topic(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return mixing.mixed(docs, MIX).select("doc_id", "source", "lang", "topic", "tokens", "probability", "selected")


# fixed values: the rules, and the method's own list of blocked hosts
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
URL_BLOCKED = ("cheap-pills.example.com", "casino-win.example.com", "free-bets.example.com")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every page: the longest rule's, else the block list's."""
    entries = [(key, verdict, True) for key, verdict in URL_RULES.items()] + [(host, "block", False) for host in URL_BLOCKED]
    known = spark.createDataFrame(entries, "key string, verdict string, rule boolean")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages, known).select("page_id", "host", "path", "rule", "verdict")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those at most two bits apart."""
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", fingerprint, "component_id")


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = langid.fit(docs.where(~F.col("held_out")).select("doc_id", "lang", "text"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op9_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes, equal texts together."""
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of secrets and those that ownership across the corpus adds, for every document. A document is
    a repository, its source the owner."""
    found = secrets.spans_of(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"] != secrets.LOOSE.name)
    of = {k.name: _count(spans, k.name) for k in secrets.BASE}
    live = F.size(F.filter(spans, lambda x: x["live"])).cast("long")
    return found.select(
        "doc_id", *[n.alias(f"n_{k}") for k, n in of.items()],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"), live.alias("n_live"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of personal data and those that the random field adds, for every document."""
    field = pii.fit(pii.labelled_table(spark))
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), field)
    spans = F.col("spans")
    of = [_count(F.filter(spans, lambda x: x["base"]), k).alias(f"n_{k}") for k in pii.BASE]
    base = F.sha2(pii.listed(F.filter(spans, lambda x: x["base"])).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *of, base, pii.listed(spans).alias("spans"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.ranked(collocations.mine(docs), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_exact_topk": op2_exact_topk,
    "op3_wrapper_extraction": op3_wrapper_extraction,
    "op4_cover_tree_dedup": op4_cover_tree_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_url_rules": op6_url_rules,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_best_fit_shards": op9_best_fit_shards,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_personal_data": op12_personal_data,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLES: dict[str, str] = {
    "op6_url_rules": f"""
        WITH p AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), rules(host, path, verdict) AS (VALUES
            {", ".join(f"('{k.partition('/')[0]}', '/{k.partition('/')[2]}', '{v}')" for k, v in URL_RULES.items())}
        ), fits AS (
            SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
                   max_by(r.verdict, length(r.host || r.path)) AS verdict
            FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
            GROUP BY p.page_id
        ), blocked(host) AS (VALUES {", ".join(f"('{h}')" for h in URL_BLOCKED)})
        SELECT p.page_id, p.host, p.path, f.rule,
               coalesce(f.verdict, CASE WHEN EXISTS (
                   SELECT 1 FROM blocked b WHERE p.host = b.host OR ends_with(p.host, '.' || b.host)
               ) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN fits f USING (page_id)
    """,
    "op2_exact_topk": """
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                   vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_conversation_trie": """
        WITH h AS (
            SELECT conv_id AS c, conv_id - conv_id % 100 AS b, xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))
            ), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
        ), turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        ), own AS (
            SELECT conv_id, {'role': role, 'text': text} AS t, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256('0:' || strlen(role) || ':' || role || text)) AS i
            FROM turns
        ), rebuilt AS (
            SELECT c, 0 AS part, i, t FROM h JOIN own ON conv_id = b AND i <= h
            UNION ALL SELECT c, 1, i, t FROM h JOIN own ON conv_id = c AND i > h
        ), paths AS (
            SELECT c, coalesce(list(t ORDER BY part, i) FILTER (t IS NOT NULL), []) AS p FROM h LEFT JOIN rebuilt USING (c) GROUP BY c
        ), members AS (
            SELECT c, d, p[1 : d] AS q, len(p) = d AS ends FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM paths)
        ), nodes AS (
            SELECT d, q, min(c) AS conv_id, count(*) AS n,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends
            FROM members GROUP BY d, q
        ), below AS (
            SELECT x.d, x.q, count(*) FILTER (y.d = x.d + 1) AS n_children, sum(CASE WHEN y.d > 0 THEN (y.n - 1) * length(y.q[-1].text) ELSE 0 END) AS saved
            FROM nodes x JOIN nodes y ON y.d >= x.d AND y.q[1 : x.d] = x.q GROUP BY x.d, x.q
        ), leaves AS (
            SELECT x.d, x.q, count(*) AS n_leaves
            FROM nodes x JOIN below y ON y.n_children = 0 AND y.d >= x.d AND y.q[1 : x.d] = x.q GROUP BY x.d, x.q
        )
        SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, b.n_children, l.n_leaves,
               b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
        FROM nodes n JOIN below b USING (d, q) JOIN leaves l USING (d, q)
        LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.q = n.q[1 : n.d - 1]
    """,
    "op13_phrase_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(
                coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), lists AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda w: w <> '') AS w FROM pieces
        ), grams AS (
            SELECT lang, d, unnest(list_transform(range(1, len(w) - d + 2), lambda i: array_to_string(w[i : i + d - 1], ' '))) AS phrase
            FROM lists, (SELECT unnest(range(1, 6)) AS d) WHERE len(w) >= d
        ), f AS (
            SELECT lang, phrase, d, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
        ), n AS (
            SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang
        ), c AS (
            SELECT *, string_split(phrase, ' ') AS w FROM f WHERE d > 1
        ), parts AS (
            SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS most
            FROM c, (SELECT unnest(range(2, 5)) AS m), (SELECT unnest(range(1, 5)) AS i) WHERE m < d AND i + m - 1 <= d
            GROUP BY ALL
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, k,
                   (1000::HUGEINT * c.a::HUGEINT * n.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
            FROM c JOIN n USING (lang) CROSS JOIN (SELECT unnest(range(1, 5)) AS k)
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')
            LEFT JOIN parts p ON p.lang = c.lang AND p.phrase = c.phrase
            WHERE k < c.d AND (p.most IS NULL OR 100 * p.most < 100 * c.a)
        ), lowest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
               a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM lowest QUALIFY rank <= 2000
    """,
}
