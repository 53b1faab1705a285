"""Queries over the fixture tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.functions import vectors as V
from loomtext.operators import bayes, lexicon, lsa, neural, sampling, search, terms, wordvec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["vocabulary_topn"](spark, sf_dir)


_TOKENS = "list_transform(regexp_extract_all(coalesce(text, ''), '(?i)[а-яё]+(?:[''’-][а-яё]+)*|[a-z]+(?:[''’-][a-z]+)*'), lambda x: lower(x))"
_TOK = f"tok AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)"
_TF = f"{_TOK}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
_N = "(SELECT count(*) FROM documents)"
#: Small lexicons of the fixtures' languages: synonym to canonical form, and stop words.
SYNONYMS = [("ein", "der"), ("die", "der"), ("das", "der"), ("une", "le"), ("la", "le"), ("les", "le"), ("los", "el"), ("las", "el")]
STOPS = ["the", "a", "of", "and", "to", "de", "le", "und", "el"]
LEMMAS = [("thes", "the"), ("anen", "an"), ("onen", "on"), ("eux", "eu"), ("enten", "ente")]
_LEX = (
    "syn(form, canonical) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + "), stops(word) AS (VALUES " + ", ".join(f"('{w}')" for w in STOPS)
    + "), lem(form, lemma) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LEMMAS) + ")"
)
_NORM = f"{_TOK}, {_LEX}, l AS (SELECT t.doc_id, t.term, coalesce(lem.lemma, t.term) AS lemma FROM tok t LEFT JOIN lem ON t.term = lem.form), n AS (SELECT l.*, coalesce(s.canonical, l.lemma) AS canonical FROM l LEFT JOIN syn s ON l.lemma = s.form WHERE l.lemma NOT IN (SELECT word FROM stops) AND l.term NOT IN (SELECT word FROM stops))"
_LABELLED = "lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label FROM labels)"


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("term"))


def lexicons(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.createDataFrame(LEMMAS, "form string, lemma string"), spark.createDataFrame(SYNONYMS, "form string, canonical string"), spark.createDataFrame([(w,) for w in STOPS], "word string")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return table(spark, sf_dir, "labels").select("doc_id", kind.alias("label"))


# ---- text


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def tokenize_documents(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH {_TOK} SELECT term, count(*) AS cnt FROM tok GROUP BY term ORDER BY cnt DESC, term LIMIT 20")
def vocabulary_topn(spark, sf_dir):
    return terms.vocabulary(tokens_of(spark, sf_dir)).limit(20)


@query(f"WITH {_TOK} SELECT term, count(*) AS cnt FROM tok GROUP BY term")
def vocabulary(spark, sf_dir):
    return tokens_of(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


@query(r"""
WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(replace(coalesce(text, ''), chr(10), chr(1)), '([.!?…])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM conversations)
SELECT conv_id, turn, len(s) AS n_sentences, length(array_to_string(s, '')) AS n_chars FROM s""")
def sentence_split(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.sentences(F.col("text")).alias("s"))
    return s.select("conv_id", "turn", F.size("s").cast("long").alias("n_sentences"), F.length(F.array_join("s", "")).cast("long").alias("n_chars"))


_FLAT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_FLAT}) AS flat_md5, CASE WHEN length({_FLAT}) <= 160 THEN {_FLAT} ELSE rtrim(substr({_FLAT}, 1, 159)) || '…' END AS snippet FROM documents")
def normalize_ws_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("flat_md5"), X.snippet(F.col("text")).alias("snippet"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM l""")
def load_lines(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", X.lines(F.col("text")).alias("l"))
    return t.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


def _vote(line: str) -> str:
    """SQL: the delimiter found most often in the line."""
    n = [f"length({line}) - length(replace({line}, {d}, ''))" for d in ("chr(9)", "','", "';'")]
    return f"CASE WHEN greatest({', '.join(n)}) = 0 THEN ',' WHEN {n[0]} = greatest({', '.join(n)}) THEN chr(9) WHEN {n[1]} = greatest({', '.join(n)}) THEN ',' ELSE ';' END"


_FIRST_LINE = r"list_filter(string_split_regex(coalesce(text, ''), '\r\n|[\n\r]'), lambda x: regexp_matches(x, '\S'))[1]"


@query(f"WITH f AS (SELECT doc_id, coalesce({_FIRST_LINE}, '') AS l FROM documents) SELECT doc_id, {_vote('l')} AS delimiter FROM f")
def delimiter_vote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.delimiter(X.first_line(F.col("text"))).alias("delimiter"))


#: Lines of a file's head, by doc_id modulo 6; the other documents give their own first 30 characters.
_HEADS = ["text,label", "отзыв;тональность", " Review ,,Sentiment", "class\trating"]
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(rf"""
WITH l AS (SELECT doc_id, CASE doc_id % 6 {" ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS))} ELSE left(coalesce(text, ''), 30) END AS line FROM documents),
c AS (SELECT doc_id, list_transform(string_split(line, {_vote("line")}), lambda x: lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS cells FROM l),
f AS (SELECT doc_id, cells, list_filter(cells, lambda x: x <> '') AS words FROM c)
SELECT doc_id, len(words) > 0 AND len(list_filter(words, lambda x: x NOT IN {_IN(X.SENTIMENT_FIRST + X.LABEL_FIRST)})) = 0 AS is_header,
       CASE WHEN len(list_distinct(list_filter(cells, lambda x: x IN {_IN(X.SENTIMENT_FIRST)}))) > len(list_distinct(list_filter(cells, lambda x: x IN {_IN(X.LABEL_FIRST)}))) THEN 'sentiment_first' ELSE 'label_first' END AS orientation
FROM f""")
def header_detect(spark, sf_dir):
    line = F.substring(X.or_empty(F.col("text")), 1, 30)
    for i, h in enumerate(_HEADS):
        line = F.when(F.col("doc_id") % 6 == i, h).otherwise(line)
    cells = table(spark, sf_dir, "documents").select("doc_id", line.alias("line")).select("doc_id", F.split("line", X.delimiter(F.col("line"))).alias("cells"))
    return cells.select("doc_id", X.is_header(F.col("cells")).alias("is_header"), X.orientation(F.col("cells")).alias("orientation"))


_RAW_LABEL = "CASE WHEN toxic = 1 THEN ' NEG ' WHEN quality = 1 THEN 'Positive' WHEN doc_id % 3 = 0 THEN 'neautral' WHEN doc_id % 3 = 1 THEN 'Neut' ELSE 'good' END"


@query(f"WITH r AS (SELECT doc_id, lower(trim({_RAW_LABEL})) AS raw FROM labels) SELECT doc_id, CASE raw {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in X.LABELS.items())} ELSE '' END AS label FROM r")
def label_alias(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", X.label(F.expr(_RAW_LABEL)).alias("label"))


@query(rf"""
WITH d AS (SELECT doc_id, {_vote("text")} AS d, text FROM (SELECT doc_id, {_RAW_LABEL} || ';' || left(replace(coalesce(text, ''), chr(10), ' '), 200) AS text FROM labels JOIN documents USING (doc_id))),
c AS (SELECT doc_id, string_split(text, d) AS cells FROM d),
r AS (SELECT doc_id, lower(trim(cells[1])) AS raw, trim(regexp_replace(array_to_string(cells[2:], ','), '\s+', ' ', 'g')) AS text FROM c WHERE len(cells) >= 2),
n AS (SELECT doc_id, CASE raw {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in X.LABELS.items())} ELSE '' END AS label, text FROM r)
SELECT * FROM n WHERE label <> '' AND text <> ''""")
def review_rows(spark, sf_dir):
    """Label and text of delimited rows, by the functions that the file reader uses."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    line = F.concat(F.expr(_RAW_LABEL), F.lit(";"), F.substring(F.replace(X.or_empty(F.col("text")), F.lit("\n"), F.lit(" ")), 1, 200))
    rows = rows.select("doc_id", line.alias("line")).withColumn("d", X.delimiter(F.col("line")))
    cells = X.split_row(F.array("line"), F.col("d"))
    rows = rows.select("doc_id", F.when(F.col("d") == "\t", F.split("line", "\t")).otherwise(cells).alias("cells")).where(F.size("cells") >= 2)
    return rows.select("doc_id", X.review_of(F.col("cells"), F.lit(False)).alias("r")).select("doc_id", "r.label", "r.text").where("label != '' and text != ''")


@query("SELECT doc_id, CASE WHEN strpos(source, '_') > 0 THEN string_split(source, '_')[1] ELSE string_split(source, '.')[1] END AS topic FROM documents")
def source_topic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.topic_of(F.col("source")).alias("topic"))


# ---- lexicons


@query(f"WITH {_NORM} SELECT doc_id, canonical AS term, count(*) AS cnt FROM n GROUP BY ALL")
def canonical_tokens(spark, sf_dir):
    t = lexicon.doc_terms(lexicon.exploded(table(spark, sf_dir, "documents")), "canonical", *lexicons(spark))
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"WITH {_NORM} SELECT 'raw' AS mode, count(DISTINCT term) AS size FROM tok UNION ALL SELECT 'lemma', count(DISTINCT lemma) FROM n UNION ALL SELECT 'canonical', count(DISTINCT canonical) FROM n")
def doc_tokens_modes_vocab_size(spark, sf_dir):
    t = lexicon.exploded(table(spark, sf_dir, "documents"))
    out = None
    for mode in ("raw", "lemma", "canonical"):
        one = lexicon.doc_terms(t, mode, *lexicons(spark)).select("term").distinct().agg(F.count("term").alias("size")).select(F.lit(mode).alias("mode"), "size")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def stemmed_vocabulary(spark, sf_dir):
    """Stems of the vocabulary, its letters written in Cyrillic so that there is something to stem."""
    return lexicon.stems(tokens_of(spark, sf_dir).select(F.translate("term", "abcdefghijklmnoprstuvwyz", "абцдефгхийклмнопрстувшыз").alias("term")))


@query(f"""
WITH docs AS (SELECT doc_id, {_TOKENS} AS words FROM documents), tok AS (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM docs), {_LEX},
l AS (SELECT t.*, coalesce(lem.lemma, t.term) AS lemma FROM tok t LEFT JOIN lem ON t.term = lem.form),
n AS (SELECT l.*, coalesce(s.canonical, l.lemma) AS canonical, l.lemma IN (SELECT word FROM stops) OR l.term IN (SELECT word FROM stops) AS stop FROM l LEFT JOIN syn s ON l.lemma = s.form)
SELECT d.doc_id, md5(coalesce(string_agg(n.canonical, ' ' ORDER BY n.pos), '')) AS digest, count(*) FILTER (WHERE n.stop) AS stopwords
FROM docs d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def normalized_text(spark, sf_dir):
    """Canonical words joined again, stop words kept and counted."""
    n = lexicon.normalized_text(table(spark, sf_dir, "documents"), *lexicons(spark))
    return n.select("doc_id", F.md5("normalized").alias("digest"), "stopwords")


# ---- terms


@query(f"WITH {_TF} SELECT term, df FROM df")
def doc_frequency(spark, sf_dir):
    return terms.document_frequency(terms.counted(table(spark, sf_dir, "documents")))


def _kept(spark, sf_dir, min_df=3, max_df=0.5):
    docs = table(spark, sf_dir, "documents")
    tf, n = terms.counted(docs), docs.count()
    return tf, terms.pruned(terms.document_frequency(tf), n, min_df, max_df).persist(), n  # terms, each read some times


_PRUNED = f"{_TF}, kept AS (SELECT term, df FROM df WHERE df >= 3 AND df <= 0.5 * {_N})"


@query(f"WITH {_PRUNED} SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM kept")
def df_pruned_vocab(spark, sf_dir):
    _, kept, _ = _kept(spark, sf_dir)
    return terms.indexed(kept, also=("df",)).select("term", "df", "idx")


@query(f"WITH {_TF} SELECT doc_id, term, tf FROM tf")
def term_frequency(spark, sf_dir):
    return terms.counted(table(spark, sf_dir, "documents"))


@query(f"WITH {_PRUNED} SELECT term, round(ln((1 + {_N}::DOUBLE) / (1 + df)) + 1, 6) AS idf FROM kept")
def idf_smooth(spark, sf_dir):
    _, kept, n = _kept(spark, sf_dir)
    return terms.idf(kept, n).select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {_PRUNED} SELECT term, round(ln({_N}::DOUBLE / df) + 1, 6) AS idf FROM kept")
def idf_raw(spark, sf_dir):
    _, kept, n = _kept(spark, sf_dir)
    return terms.idf(kept, n, False).select("term", F.round("idf", 6).alias("idf"))


_W = f"{_PRUNED}, w AS (SELECT doc_id, tf.term, %s * (ln((1 + {_N}::DOUBLE) / (1 + df)) + 1) AS w FROM tf JOIN kept USING (term))"


@query(f"WITH {_W % '(1 + ln(tf))'} SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w")
def tfidf_l2(spark, sf_dir):
    tf, kept, n = _kept(spark, sf_dir)
    return terms.tfidf(tf, terms.idf(kept, n), sublinear=True).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_W % 'tf'} SELECT doc_id, term, round(w, 6) AS weight FROM w")
def tfidf_raw(spark, sf_dir):
    tf, kept, n = _kept(spark, sf_dir)
    return terms.tfidf(tf, terms.idf(kept, n), l2=False).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_PRUNED} SELECT round(1 - (SELECT count(*) FROM tf JOIN kept USING (term))::DOUBLE / ({_N} * (SELECT count(*) FROM kept)), 6) AS sparsity")
def tfidf_sparsity(spark, sf_dir):
    _, kept, n = _kept(spark, sf_dir)
    both = kept.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("nnz"), F.count(F.lit(1)).alias("m"))  # a term has df cells
    return both.select(F.round(1 - F.col("nnz") / (F.lit(n) * F.col("m")), 6).alias("sparsity"))


# ---- samples


@query(f"WITH {_LABELLED} SELECT label, count(*) AS cnt FROM lab GROUP BY label")
def class_counts(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))


_SPLIT = f"{_LABELLED}, split AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) <= CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN greatest(1, least(round_even(count(*) OVER (PARTITION BY label) * 0.2, 0), count(*) OVER (PARTITION BY label) - 1)) ELSE 0 END AS is_test FROM lab)"


@query(f"WITH {_SPLIT} SELECT doc_id, label, is_test FROM split")
def stratified_split_assign(spark, sf_dir):
    return sampling.stratified_split(labelled(spark, sf_dir)).select("doc_id", "label", "is_test")


@query(f"WITH {_SPLIT} SELECT label, is_test, count(*) AS cnt FROM split GROUP BY ALL")
def stratified_split_counts(spark, sf_dir):
    return sampling.stratified_split(labelled(spark, sf_dir)).groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("cnt"))


_QUOTA = f"{_LABELLED}, r AS (SELECT doc_id, label, dense_rank() OVER (ORDER BY label) - 1 AS i, row_number() OVER (PARTITION BY label ORDER BY %s) AS rn FROM lab) SELECT doc_id, label FROM r WHERE rn <= 100 // (SELECT count(DISTINCT label) FROM lab) + CASE WHEN i < 100 %% (SELECT count(DISTINCT label) FROM lab) THEN 1 ELSE 0 END"


@query(f"WITH {_QUOTA % 'doc_id'}")
def balanced_subset(spark, sf_dir):
    return sampling.quota(labelled(spark, sf_dir), 100).select("doc_id", "label")


@query("WITH " + _QUOTA % "md5('42|' || doc_id::VARCHAR), doc_id")
def balanced_seed_sample(spark, sf_dir):
    return sampling.quota(labelled(spark, sf_dir), 100, seed=42).select("doc_id", "label")


@query(f"WITH {_LABELLED} SELECT label, min(doc_id) AS doc_id FROM lab GROUP BY label")
def first_per_class(spark, sf_dir):
    return sampling.first_per_label(labelled(spark, sf_dir)).select("label", "doc_id")


@query(f"WITH {_LABELLED} SELECT doc_id, label FROM lab QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) <= 5")
def first_n_per_class(spark, sf_dir):
    return sampling.first_per_label(labelled(spark, sf_dir), 5).select("doc_id", "label")


# ---- naive Bayes

_NB = f"""{_SPLIT}, {_TOK}, train AS (SELECT doc_id, label FROM split WHERE NOT is_test),
c AS (SELECT label, term, count(*) AS c FROM tok JOIN train USING (doc_id) GROUP BY ALL),
v AS (SELECT count(DISTINCT term) AS v FROM c), lab3 AS (SELECT DISTINCT label FROM train),
t AS (SELECT lab3.label, coalesce(sum(c), 0) AS t FROM lab3 LEFT JOIN c ON c.label = lab3.label GROUP BY 1),
prior AS (SELECT label, ln(count(*)::DOUBLE / (SELECT count(*) FROM train)) AS prior_log FROM train GROUP BY label),
base AS (SELECT label, ln(1.0 / (t + v)) AS base_log FROM t, v),
cond AS (SELECT label, term, ln((c + 1.0) / (t + v)) AS cond_log FROM c JOIN t USING (label), v),
known AS (SELECT doc_id, term FROM tok WHERE term IN (SELECT term FROM c) AND doc_id IN (SELECT doc_id FROM labels)),
n AS (SELECT doc_id, count(*) AS n FROM known GROUP BY doc_id),
lift AS (SELECT doc_id, cond.label, sum(cond_log - base_log) AS lift FROM known JOIN cond USING (term) JOIN base ON base.label = cond.label GROUP BY ALL),
logp AS (SELECT s.doc_id, p.label, prior_log + coalesce(n, 0) * base_log + coalesce(lift, 0) AS logp FROM split s CROSS JOIN prior p JOIN base b ON b.label = p.label LEFT JOIN n ON n.doc_id = s.doc_id LEFT JOIN lift l ON l.doc_id = s.doc_id AND l.label = p.label),
pred AS (SELECT doc_id, label AS predicted FROM logp QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY logp DESC, label) = 1)"""


def _nb(spark, sf_dir):
    split = sampling.stratified_split(labelled(spark, sf_dir))
    tokens = tokens_of(spark, sf_dir).join(split.select("doc_id"), "doc_id")
    model = bayes.fit(split.where(~F.col("is_test")).select("doc_id", "label"), tokens)
    return split, tokens, model


@query(f"WITH {_NB} SELECT label, round(prior_log, 6) AS prior_log FROM prior")
def nb_priors(spark, sf_dir):
    return _nb(spark, sf_dir)[2].prior.select("label", F.round("prior_log", 6).alias("prior_log"))


@query(f"WITH {_NB} SELECT label, term, round(cond_log, 6) AS cond_log FROM cond")
def nb_cond_log(spark, sf_dir):
    return _nb(spark, sf_dir)[2].cond.select("label", "term", F.round("cond_log", 6).alias("cond_log"))


def _logp(spark, sf_dir):
    split, tokens, model = _nb(spark, sf_dir)
    return split, bayes.log_proba(model, split, tokens)


@query(f"WITH {_NB} SELECT doc_id, label, round(logp, 4) AS logp FROM logp")
def nb_log_proba(spark, sf_dir):
    return _logp(spark, sf_dir)[1].select("doc_id", "label", F.round("logp", 4).alias("logp"))


@query(f"WITH {_NB}, e AS (SELECT doc_id, label, exp(logp - max(logp) OVER (PARTITION BY doc_id)) AS e FROM logp) SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 5) AS p FROM e")
def nb_predict_proba(spark, sf_dir):
    return bayes.proba(_logp(spark, sf_dir)[1]).select("doc_id", "label", F.round("p", 5).alias("p"))


@query(f"WITH {_NB} SELECT doc_id, predicted FROM pred")
def nb_predict(spark, sf_dir):
    return bayes.predict(_logp(spark, sf_dir)[1])


@query(f"WITH {_NB} SELECT is_test, count(*) AS cnt, round(avg((predicted = label)::INT), 6) AS accuracy FROM split JOIN pred USING (doc_id) GROUP BY is_test")
def nb_accuracy(spark, sf_dir):
    split, logp = _logp(spark, sf_dir)
    hit = split.join(bayes.predict(logp), "doc_id").withColumn("hit", (F.col("predicted") == F.col("label")).cast("double"))
    return hit.groupBy("is_test").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.avg("hit"), 6).alias("accuracy"))


# ---- vectors and search

_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _queries(vec: DataFrame) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 100."""
    return vec.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vec")


_SEARCH = f"{_E}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id %% 100 = 0 %s), top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank, id, score FROM s QUALIFY rank <= 10)"


@query(f"WITH {_SEARCH % ''} SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM top")
def cosine_topk(spark, sf_dir):
    vec = vectors(spark, sf_dir)
    return search.search(_queries(vec), vec, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_SEARCH % 'AND e.vec_id <> q.vec_id'} SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM top")
def similar_exclude_self(spark, sf_dir):
    vec = vectors(spark, sf_dir)
    return search.search(_queries(vec), vec, 10, exclude_self=True).withColumn("score", F.round("score", 6))


@query(f"WITH {_SEARCH % 'AND e.vec_id <> q.vec_id'} SELECT round(avg((a.label = b.label)::INT), 6) AS agreement FROM top JOIN e a ON a.vec_id = query_id JOIN e b ON b.vec_id = id WHERE rank = 1")
def top1_agreement(spark, sf_dir):
    vec = vectors(spark, sf_dir)
    best = search.search(_queries(vec), vec, 1, exclude_self=True)
    a, b = vec.select(F.col("id").alias("query_id"), F.col("label").alias("x")), vec.select("id", F.col("label").alias("y"))
    return best.join(a, "query_id").join(b, "id").agg(F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("agreement"))


@query(f"""WITH {_SEARCH % 'AND e.vec_id <> q.vec_id'}, k AS (SELECT query_id, list(DISTINCT b.label) AS s, any_value(a.label) AS own FROM top JOIN e a ON a.vec_id = query_id JOIN e b ON b.vec_id = id WHERE rank <= 3 GROUP BY query_id)
SELECT round(avg(CASE WHEN list_contains(s, own) THEN 1.0 / len(s) ELSE 0 END), 6) AS jaccard FROM k""")
def topk_jaccard(spark, sf_dir):
    """Mean overlap of the labels of the three nearest with the query's own label."""
    vec = vectors(spark, sf_dir)
    near = search.search(_queries(vec), vec, 3, exclude_self=True)
    a, b = vec.select(F.col("id").alias("query_id"), F.array("label").alias("own")), vec.select("id", F.col("label").alias("y"))
    sets = near.join(b, "id").groupBy("query_id").agg(F.collect_set("y").alias("s")).join(a, "query_id")
    return sets.agg(F.round(F.avg(F.size(F.array_intersect("s", "own")) / F.size(F.array_union("s", "own"))), 6).alias("jaccard"))


_MEAN = f"{_E}, d AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS dim FROM e), m AS (SELECT label, dim, avg(x) AS x FROM d GROUP BY ALL)"


@query(f"WITH {_MEAN} SELECT label, dim, round(x, 6) AS mean FROM m")
def mean_pool_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean")).withColumn("dim", F.col("dim").cast("long"))


@query(f"""WITH {_MEAN}, c AS (SELECT label, list(x ORDER BY dim) AS v FROM m GROUP BY label), q AS (SELECT list(a.x - b.x + c.x ORDER BY a.dim) AS v FROM m a JOIN m b USING (dim) JOIN m c USING (dim) WHERE a.label = 0 AND b.label = 1 AND c.label = 2)
SELECT label, round(list_cosine_similarity(c.v, q.v), 6) AS score FROM c, q WHERE label NOT IN (0, 1, 2)""")
def word_analogy(spark, sf_dir):
    """Centroid 0 - 1 + 2 against the other centroids."""
    means = vectors(spark, sf_dir).select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    cents = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))
    three = cents.where("label in (0, 1, 2)").agg(*[F.max(F.when(F.col("label") == i, F.col("vec"))).alias(f"v{i}") for i in range(3)])
    q = three.select(F.zip_with(F.zip_with("v0", "v1", lambda x, y: x - y), "v2", lambda x, y: x + y).alias("q"))
    return cents.where("label not in (0, 1, 2)").join(F.broadcast(q)).select("label", F.round(V.cosine(F.col("vec"), F.col("q")), 6).alias("score"))  # one row


@query(f"WITH {_E} SELECT vec_id AS id, round(sqrt(list_dot_product(v, v)), 6) AS norm, sqrt(list_dot_product(v, v)) <= 1e-12 AS degenerate FROM e")
def zero_norm_guard(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.round(V.norm(F.col("vec")), 6).alias("norm"), V.degenerate(F.col("vec")).alias("degenerate"))


@query("SELECT min(doc_id) AS twin, count(DISTINCT doc_id) AS cnt FROM documents WHERE text IS NOT NULL GROUP BY text")
def twin_lookup(spark, sf_dir):
    """Each distinct text's first document, and how many have it."""
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("doc_id").alias("twin"), F.count_distinct("doc_id").alias("cnt")).select("twin", "cnt")


# ---- skip-gram preparation

_POS = f"pos AS (SELECT doc_id, unnest({_TOKENS}) AS term, unnest(range(len({_TOKENS}))) AS pos FROM documents)"
#: Distances of a window of two words on either side.
_NEAR = "(VALUES (-2), (-1), (1), (2)) d(k)"


@query(f"WITH {_POS} SELECT a.term AS center, b.term AS context, count(*) AS cnt FROM pos a, {_NEAR} JOIN pos b ON a.doc_id = b.doc_id AND b.pos = a.pos + d.k GROUP BY ALL")
def skipgram_pairs(spark, sf_dir):
    """Counts of (center, context) within two words; pairs are formed inside each row's array, without a join.

    Either word of a pair is the other's context, so each pair is counted once, with the lesser word first, and given both ways.
    """
    t = table(spark, sf_dir, "documents").select(X.tokenize(F.col("text")).alias("t"))
    ahead = F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, 2), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
    counts = t.select(F.explode(F.flatten(ahead)).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    ways = lambda x, y, n: F.struct(F.col(x).alias("center"), F.col(y).alias("context"), n.alias("cnt"))
    both = F.when(F.col("a") == F.col("b"), F.array(ways("a", "b", 2 * F.col("n")))).otherwise(F.array(ways("a", "b", F.col("n")), ways("b", "a", F.col("n"))))
    return counts.select(F.explode(both).alias("r")).select("r.center", "r.context", "r.cnt")


@query(f"WITH {_POS}, n AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY doc_id) SELECT doc_id, sum(least(pos, 2) + least(n - 1 - pos, 2))::BIGINT AS n_pairs FROM pos JOIN n USING (doc_id) GROUP BY doc_id")
def context_window(spark, sf_dir):
    """Pairs that a window of two gives in each document."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokenize(F.col("text"))).alias("n")).where("n > 0")
    each = F.aggregate(F.sequence(F.lit(1), F.lit(2)), F.lit(0).cast("long"), lambda s, k: s + 2 * F.greatest(F.col("n") - k, F.lit(0)))
    return t.select("doc_id", each.alias("n_pairs"))


_CDF = f"{_TF}, p AS (SELECT term, pow(count(*), 0.75) AS w FROM tok GROUP BY term HAVING count(*) >= 5), cdf AS (SELECT term, sum(w) OVER (ORDER BY term) / sum(w) OVER () AS cum, w / sum(w) OVER () AS p FROM p)"


def _cdf(spark, sf_dir) -> DataFrame:
    """Unigram distribution ^0.75 of terms found five times or more, summed in order of term.

    The running sum is taken inside range partitions and lifted by the partitions' totals.
    """
    p = tokens_of(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("c")).where("c >= 5").select("term", F.pow("c", F.lit(0.75)).alias("w")).persist()  # read for the ranges, then dealt to them
    parts = p.repartitionByRange(max(1, spark.sparkContext.defaultParallelism), "term").withColumn("p", F.spark_partition_id())
    inner = parts.withColumn("run", F.sum("w").over(Window.partitionBy("p").orderBy("term"))).persist()  # totals and rows must come of one and the same partitioning
    sums = inner.groupBy("p").agg(F.max("run").alias("s"))
    lift = sums.withColumn("skip", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("all", F.sum("s").over(Window.partitionBy()))  # one row per partition
    return inner.join(F.broadcast(lift), "p").select("term", ((F.col("skip") + F.col("run")) / F.col("all")).alias("cum"), (F.col("w") / F.col("all")).alias("p"))


@query(f"WITH {_CDF} SELECT term, round(cum, 6) AS cum, round(p, 9) AS p FROM cdf")
def unigram_cdf(spark, sf_dir):
    return _cdf(spark, sf_dir).select("term", F.round("cum", 6).alias("cum"), F.round("p", 9).alias("p"))


@query(f"WITH {_CDF}, u AS (SELECT vec_id, (vec_id * 7919 % 1000 + 0.5) / 1000 AS u FROM embeddings) SELECT vec_id, (SELECT min(term) FROM cdf WHERE cum >= u) AS term FROM u")
def negative_sample_asof(spark, sf_dir):
    """Inverse of the distribution at given draws: the first term whose running sum reaches the draw.

    The draws are of 1,000 values at most; each is looked up once, whatever the number of rows that have it.
    """
    u = table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("vec_id") * 7919 % 1000 + 0.5) / 1000).alias("u"))
    cdf = _cdf(spark, sf_dir).select("term", "cum", (F.col("cum") - F.col("p")).alias("low"))
    grid = cdf.withColumn("cell", F.explode(F.sequence(F.floor(F.greatest(F.col("low"), F.lit(0.0)) * 1000 - 1e-6).cast("int"), F.floor(F.col("cum") * 1000 + 1e-6).cast("int"))))
    hit = u.select("u").distinct().withColumn("cell", F.floor(F.col("u") * 1000).cast("int")).join(grid, "cell").where(F.col("cum") >= F.col("u"))
    first = hit.groupBy("u").agg(F.min(F.struct("cum", "term")).getField("term").alias("term"))
    return u.join(F.broadcast(first), "u", "left").select("vec_id", "term")


@query(f"WITH t AS (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations), v AS (SELECT term, row_number() OVER (ORDER BY term) AS idx FROM (SELECT DISTINCT unnest(t) AS term FROM t)), p AS (SELECT conv_id, turn, unnest(t) AS term, unnest(range(len(t))) AS pos FROM t), i AS (SELECT conv_id, turn, list(idx ORDER BY pos) AS ids FROM p JOIN v USING (term) GROUP BY ALL) SELECT t.conv_id, t.turn, least(len(t.t), 64)::INT AS length, md5(array_to_string(list_resize(list_concat(coalesce(ids, []), []), 64, 0), ' ')) AS ids_md5 FROM t LEFT JOIN i USING (conv_id, turn)")
def pad_indices(spark, sf_dir):
    """Word indices from 1, cut or filled with 0 to 64."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokenize(F.col("text")).alias("t"))
    vocab = terms.indexed(rows.select(F.explode("t").alias("term")).distinct(), first=1)
    flat = rows.select("conv_id", "turn", F.posexplode("t").alias("pos", "term")).join(vocab, "term")
    ids = flat.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda s: s["idx"].cast("int")).alias("ids"))
    out = rows.join(ids, ["conv_id", "turn"], "left").select("conv_id", "turn", F.least(F.size("t"), F.lit(64)).alias("length"), X.pad(F.coalesce("ids", F.array().cast("array<int>")), 64).alias("ids"))
    return out.select("conv_id", "turn", "length", F.md5(F.array_join("ids", " ")).alias("ids_md5"))


# ---- latent topics


def _lsa(spark, sf_dir, k=5):
    tf, kept, n = _kept(spark, sf_dir, min_df=20, max_df=0.5)
    idx = terms.indexed(kept, also=("df",))
    weights = terms.tfidf(tf, terms.idf(idx, n), also=("idx",)).select("doc_id", "idx", "weight")
    return lsa.fit(weights, k), idx.select("term", "idx")


@query()
def lsa_fit_sigma(spark, sf_dir):
    """Singular values and their share of the retained spectrum."""
    model, _ = _lsa(spark, sf_dir)
    return model.sigma.withColumn("share", F.col("sigma") * F.col("sigma") / F.sum(F.col("sigma") * F.col("sigma")).over(Window.partitionBy()))  # k rows


@query()
def lsa_topics(spark, sf_dir):
    """The ten terms of each topic with the largest loadings."""
    model, idx = _lsa(spark, sf_dir)
    return lsa.topics(model, idx, 10).withColumn("loading", F.round("loading", 6))


@query()
def lsa_query(spark, sf_dir):
    """Each document whose id is divisible by 100 against all, by cosine in topic space."""
    model, _ = _lsa(spark, sf_dir)
    vec = model.documents.withColumnRenamed("doc_id", "id").persist()
    return search.search(_queries(vec), vec, 10)


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT label, i, sum(x) AS s FROM e GROUP BY ALL),
v AS (SELECT e.vec_id, e.label, s.label AS c, e.x, CASE WHEN e.label = s.label THEN s.s - e.x ELSE s.s END AS v FROM e JOIN s USING (i)),
d AS (SELECT vec_id, label, c, sum(x * v) / nullif(sqrt(sum(v * v)), 0) AS near FROM v GROUP BY ALL),
b AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY round(near, 9) DESC NULLS LAST, c) AS r, c FROM d)
SELECT label, count(*) AS n, count(*) FILTER (WHERE label = c) AS hits FROM b WHERE r = 1 GROUP BY label""")
def leave_one_out(spark, sf_dir):
    """Vectors whose label's centroid, made without them, is the nearest by cosine."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    sums = e.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    centres = sums.groupBy(F.col("label").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sum"))
    met = e.join(F.broadcast(centres))  # one row per label
    met = met.withColumn("sum", F.when(F.col("label") == F.col("c"), F.zip_with("sum", "vec", lambda a, b: a - b)).otherwise(F.col("sum")))
    size = V.norm(F.col("sum"))
    near = F.when(size > 0, V.dot(F.col("vec"), F.col("sum")) / size)
    order = Window.partitionBy("vec_id").orderBy(F.desc_nulls_last(F.round(near, 9)), "c")
    first = met.withColumn("r", F.row_number().over(order)).where("r = 1")
    return first.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("c")).alias("hits"))


@query()
def pca_2d(spark, sf_dir):
    """The embeddings on their first two principal axes; each axis's largest entry is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    vec = vectors(spark, sf_dir)
    axes = PCA(k=2, inputCol="v", outputCol="p").fit(vec.select(array_to_vector("vec").alias("v"))).pc.toArray()
    mean = vec.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()  # one row per dimension
    out = vec
    for k in range(2):
        a = axes[:, k] * (1 if axes[abs(axes[:, k]).argmax(), k] > 0 else -1)
        out = out.withColumn(f"p{k + 1}", V.dot(F.col("vec"), F.array(*map(F.lit, a.tolist()))) - float(sum(x["x"] * y for x, y in zip(mean, a))))
    return out.select("id", F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2"))


# ---- learnt document vectors


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("words"))


def _word_vectors(spark, sf_dir, *kinds):
    """A model of each kind, and the documents' (doc_id, ids), which all of them share."""
    words = _words(spark, sf_dir)
    ready = wordvec.prepared(words, 5)
    return *[wordvec.fit(words, kind, dim=32, min_count=5, epochs=1 if kind == "word" else 3, ready=ready) for kind in kinds], ready[1]


def _top(spark, sf_dir, model, n):
    """The n most common words; those of a model are the most common of all, if it has so many."""
    top = wordvec.most_common(model, n)
    return top if len(top) == n else [r.term for r in terms.vocabulary(tokens_of(spark, sf_dir)).limit(n).collect()]


@query()
def w2v_similar(spark, sf_dir):
    """The nearest words of the 20 most common ones, by vectors of negative sampling."""
    model, _ = _word_vectors(spark, sf_dir, "word")
    top = _top(spark, sf_dir, model, 20)
    return spark.createDataFrame([(q, i + 1, w, s) for q in top for i, (w, s) in enumerate(wordvec.most_similar(model, q, 5))], "query string, rank int, word string, score double")


@query()
def w2v_analogy(spark, sf_dir):
    """The three words nearest to a - b + c, over neighbours among the 21 most common words."""
    model, _ = _word_vectors(spark, sf_dir, "word")
    top = _top(spark, sf_dir, model, 21)
    rows = [(*q, i + 1, w, s) for q in zip(top[::3], top[1::3], top[2::3]) for i, (w, s) in enumerate(wordvec.analogy(model, *q))]
    return spark.createDataFrame(rows, "a string, b string, c string, rank int, word string, score double")


@query()
def w2v_query(spark, sf_dir):
    """Each document whose id is divisible by 100 against all, by the mean of its known words' vectors."""
    model, ids = _word_vectors(spark, sf_dir, "word")
    vec = wordvec.mean_pooled(model, ids).withColumnRenamed("doc_id", "id").persist()
    return search.search(_queries(vec), vec, 10, exclude_self=True)


@query()
def d2v_query(spark, sf_dir):
    """Each document whose id is divisible by 100 against all, by inferred document vectors."""
    model, ids = _word_vectors(spark, sf_dir, "document")
    vec = wordvec.inferred(model, ids).withColumnRenamed("doc_id", "id").persist()
    return search.search(_queries(vec), vec, 10, exclude_self=True)


@query()
def model_agreement(spark, sf_dir):
    """Share of the documents with an id divisible by 100 whose nearest other document is the same by word means and by inferred vectors."""
    found = []
    *models, ids = _word_vectors(spark, sf_dir, "word", "document")
    for kind, fold, model in zip(("word", "document"), (wordvec.mean_pooled, wordvec.inferred), models):
        vec = fold(model, ids).withColumnRenamed("doc_id", "id").persist()
        found.append(search.search(_queries(vec), vec, 1, exclude_self=True).select("query_id", F.col("id").alias(kind)))
    return found[0].join(found[1], "query_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("word") == F.col("document")).cast("double")).alias("agreement"))


def _network(spark, sf_dir, kind):
    topics = table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("words"), F.col("lang").alias("label"))
    return neural.train(kind, *neural.sample(topics.where("doc_id is not null and label is not null"), 1_000), epochs=3), _words(spark, sf_dir)


@query()
def cnn_predict(spark, sf_dir):
    """Topic of every document by a convolutional encoder."""
    net, words = _network(spark, sf_dir, "cnn")
    return neural.score(net, words).select("doc_id", "label", F.round(F.array_max("probabilities"), 6).alias("p"))


@query()
def gru_predict(spark, sf_dir):
    """Topic of every document by a recurrent encoder."""
    net, words = _network(spark, sf_dir, "gru")
    return neural.score(net, words).select("doc_id", "label", F.round(F.array_max("probabilities"), 6).alias("p"))


@query()
def cnn_query(spark, sf_dir):
    """Each document whose id is divisible by 100 against all, by convolutional document vectors."""
    net, words = _network(spark, sf_dir, "cnn")
    vec = neural.score(net, words).select(F.col("doc_id").alias("id"), "vec").persist()
    return search.search(_queries(vec), vec, 10, exclude_self=True)
