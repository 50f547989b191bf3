"""All queries of the engine by name, and the same in DuckDB's SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.operators import corpus, evaluation, guard, history, runs
from glyphloom.sources import vocab_json
from glyphloom.sources.tables import documents, parquet_table

Query = Callable[[SparkSession, str], DataFrame]


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.steps_of_events(parquet_table(spark, sf_dir, "events"))


def _vocab_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab_json.from_rows(vocab_json.to_rows(corpus.vocabulary(documents(spark, sf_dir))))


# Existing checkpoints for the version query: every path of the registry, and some versions of it.
_EXISTING = [
    "checkpoints/tr_best.pt", "checkpoints/tr_to_az.pt", "checkpoints/tr_to_az.ft1.pt", "checkpoints/tr_to_az.ft2.pt", "checkpoints/tr_to_kk.pt",
    "checkpoints/uz_to_fi.ft1.pt", "checkpoints/kk_to_tr.pt", "checkpoints/kk_to_tr.ft2.pt",
]


def _next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = runs.run_registry(runs.experiments(spark)).select(F.col("checkpoint_path").alias("base"))
    return runs.next_version(wanted, spark.createDataFrame([(p,) for p in _EXISTING], "path string"))


SNIPPETS = [
    ("src/a.py", "from typing import Any, cast\nx: object = cast(Any, 1)\nprint(x)\n"),
    ("src/b.py", "import typing\ntry:\n    pass\nexcept ValueError:\n    pass\ndef f(a: object) -> object:\n    return typing.cast(int, a)  # type: ignore\n"),
    ("src/c.py", "from contextlib import suppress\nwith suppress(KeyError):\n    x = 1\ntry:\n    y = 2\nexcept Exception:\n    logger.error('no')\n    raise\n"),
    ("/p/tests/test_d.py", "def test_a():\n    assert x is not None\n    assert len(x) > 0\n    assert 'a' in r.out\n    assert m.called\n"),
    ("/p/tests/test_e.py", "def test_t():\n    loss.backward()\n    opt.step()\n    y = model(x)\n    assert isinstance(y, T)\n"),
    ("/p/tests/test_f.py", "def test_ok():\n    loss.backward()\n    assert final_loss < initial_loss\n"),
]


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.violations(spark.createDataFrame(SNIPPETS, "path string, source string"))


def _model_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter tensors of the full-size model for each language's vocabulary."""
    sizes = corpus.vocabulary(documents(spark, sf_dir)).groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    shapes = [("embedding.weight", "v * 128"), ("fc.weight", "v * 256"), ("fc.bias", "v")]
    for k, width in ((0, 128), (1, 256)):
        shapes += [(f"lstm.{k}.w_ih", str(1024 * width)), (f"lstm.{k}.w_hh", str(1024 * 256)), (f"lstm.{k}.b_ih", "1024"), (f"lstm.{k}.b_hh", "1024")]
    tensors = F.array(*(F.struct(F.lit(n).alias("name"), F.expr(s).cast("long").alias("size")) for n, s in shapes))
    rows = sizes.select("lang", "v", F.explode(tensors).alias("t"))
    return rows.groupBy("lang", "v").agg(F.count(F.lit(1)).alias("n_tensors"), F.sum("t.size").alias("n_params")).withColumnRenamed("v", "vocab_size")


def queries() -> dict[str, Query]:
    docs = {
        "corpus_stats": corpus.corpus_stats, "corpus_split": corpus.corpus_split, "vocab_build": corpus.vocabulary, "encode_oov": corpus.encode_oov,
        "vocab_overlap": corpus.vocab_overlap, "next_char_windows": corpus.window_batches, "dataset_lengths": corpus.dataset_lengths,
        "batch_plan": corpus.batch_plan, "eval_loss": evaluation.eval_loss, "transfer_matrix": evaluation.transfer_matrix, "manifest_balance": corpus.balance,
    }
    steps = {
        "train_loss_windows": history.train_loss_windows, "epoch_summary": history.epoch_summary, "early_stopping": history.early_stopping,
        "convergence_auc": history.convergence_auc, "metric_log": history.metric_log,
    }
    out: dict[str, Query] = {name: lambda s, d, f=f: f(documents(s, d)) for name, f in docs.items()}
    out |= {name: lambda s, d, f=f: f(_steps(s, d)) for name, f in steps.items()}
    return out | {
        "vocab_json": _vocab_json,
        "grad_norm": lambda s, d: history.grad_norm(parquet_table(s, d, "embeddings"), "label", "embedding"),
        "run_registry": lambda s, d: runs.run_registry(runs.experiments(s)),
        "next_version": _next_version,
        "guard_violations": _violations,
        "guard_report": lambda s, d: guard.report(_violations(s, d)),
        "model_params": _model_params,
    }


_DOCS = r"""docs AS (
  SELECT doc_id, lang, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL
), offs AS (
  SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
    least(sum(length(text)) OVER (PARTITION BY lang), 10000000)::BIGINT AS n FROM docs
), kept AS (
  SELECT doc_id, lang, off, n, left(text, (10000000 - off)::BIGINT) AS text FROM offs WHERE off < 10000000 AND length(text) > 0
)"""
_BOUNDS = "trunc(n * 0.7::DOUBLE)::BIGINT AS a, trunc(n * (0.7::DOUBLE + 0.15::DOUBLE))::BIGINT AS b"
_SIZES = _DOCS + rf""", totals AS (SELECT lang, least(sum(length(text)), 10000000)::BIGINT AS n FROM docs GROUP BY lang
), edges AS (SELECT lang, n, {_BOUNDS} FROM totals
), sizes AS (
  SELECT lang, 'train' AS split, a AS n_chars FROM edges UNION ALL SELECT lang, 'val', b - a FROM edges UNION ALL SELECT lang, 'test', n - b FROM edges
)"""
_VOCAB = _DOCS + r""", chars AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM kept
), known AS (SELECT lang, ch, (row_number() OVER (PARTITION BY lang ORDER BY ch) - 1)::INTEGER AS id FROM chars WHERE ch <> ''
), vocab AS (SELECT * FROM known UNION ALL SELECT lang, '<unk>', count(*)::INTEGER FROM known GROUP BY lang)"""
# Characters with their place in the language's text, their split, their place in it, and its size.
_CHARS = _VOCAB + rf""", placed AS (
  SELECT k.lang, k.n, {_BOUNDS.replace("n *", "k.n *")}, k.off + u.i - 1 AS pos, u.ch AS ch
  FROM (SELECT *, string_split(text, '') AS l FROM kept) k, LATERAL (SELECT unnest(k.l) AS ch, generate_subscripts(k.l, 1) AS i) u
), split AS (
  SELECT lang, ch, CASE WHEN pos < a THEN 'train' WHEN pos < b THEN 'val' ELSE 'test' END AS split,
    pos - CASE WHEN pos < a THEN 0 WHEN pos < b THEN a ELSE b END AS i, CASE WHEN pos < a THEN a WHEN pos < b THEN b - a ELSE n - b END AS m FROM placed
)"""
_STEPS = r"""steps AS (
  SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step, value / 100.0::DOUBLE AS loss, sqrt(value) AS grad_norm
  FROM events WHERE event_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL
), numbered AS (SELECT *, ((step - 1) // 250 + 1)::INTEGER AS epoch FROM steps
), flushed AS (
  SELECT run, epoch, max(step) AS global_step, count(*) AS n_steps, avg(loss) AS m, arg_max(grad_norm, step) AS g FROM numbered GROUP BY run, epoch, (step - 1) // 100
), epochs AS (
  SELECT run, epoch, sum(loss) / greatest(1, count(*)) AS train_loss, coalesce(avg(loss) FILTER (WHERE step % 5 = 0), 0.0) AS val_loss, max(step) AS global_step
  FROM numbered GROUP BY run, epoch
), marked AS (
  SELECT *, val_loss < coalesce(min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS improved,
    min(val_loss) OVER (PARTITION BY run ORDER BY epoch) AS best FROM epochs
), counted AS (
  SELECT *, (epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch), 0))::INTEGER AS idle FROM marked
)"""


def _transfer(pairs: str) -> str:
    return (
        "WITH " + _CHARS + rf""", sized AS (SELECT lang, count(*) AS v FROM vocab GROUP BY lang
), coded AS (
  SELECT s.lang AS src, t.lang AS tgt, t.split, t.i, t.m, coalesce(v.id, s.v - 1) AS x
  FROM split t JOIN sized s ON {pairs} LEFT JOIN vocab v ON v.lang = s.lang AND v.ch = t.ch WHERE t.split = 'test' OR t.split = 'train' AND s.lang = t.lang
), shifted AS (SELECT *, lead(x) OVER (PARTITION BY src, tgt, split ORDER BY i) AS y FROM coded
), pairs AS (SELECT src, x, y, count(*) AS c FROM shifted WHERE split = 'train' AND y IS NOT NULL GROUP BY ALL
), firsts AS (SELECT src, x, sum(c) AS c FROM pairs GROUP BY ALL
), losses AS (
  SELECT t.src, t.tgt, t.i, t.m, -ln((coalesce(p.c, 0) + 1)::DOUBLE / (coalesce(f.c, 0) + s.v)) AS loss
  FROM shifted t JOIN sized s ON s.lang = t.src LEFT JOIN pairs p ON p.src = t.src AND p.x = t.x AND p.y = t.y LEFT JOIN firsts f ON f.src = t.src AND f.x = t.x
  WHERE t.split = 'test' AND t.y IS NOT NULL
), means AS (
  SELECT src, tgt, i, m, avg(loss) OVER (PARTITION BY src, tgt ORDER BY i ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS loss FROM losses
), batches AS (SELECT src, tgt, avg(loss) AS loss FROM means WHERE i < m - 100 GROUP BY src, tgt, i // 64
), cells AS (SELECT s.lang AS src, t.lang AS tgt FROM sized s JOIN sized t ON {pairs}
), scored AS (SELECT src, tgt, avg(loss) AS loss FROM batches GROUP BY src, tgt)
SELECT src, tgt, round(coalesce(loss, 0.0), 6) AS loss, round(exp(coalesce(loss, 0.0)), 6) AS ppl FROM cells LEFT JOIN scored USING (src, tgt)"""
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


def _registry() -> str:
    rows = [(i, *r) for i, r in enumerate(runs.EXPERIMENTS)]
    return rf"""runs(run_no, lang, from_checkpoint, freeze_embed) AS (VALUES {_values(rows)}
), names(lang, lang_name) AS (VALUES {_values(list(runs.LANGUAGES.items()))}
), based AS (SELECT *, replace(regexp_extract(from_checkpoint, '([^/]+)\.[^./]*$', 1), '_best', '') AS base FROM runs JOIN names USING (lang)
), registry AS (
  SELECT run_no::INTEGER AS run_no, lang, lang_name, coalesce(from_checkpoint, '') AS from_checkpoint, freeze_embed,
    CASE WHEN from_checkpoint IS NULL THEN lang || '-train' ELSE base || '->' || lang END AS run_name,
    CASE WHEN from_checkpoint IS NULL THEN 'checkpoints/' || lang || '_best.pt' ELSE 'checkpoints/' || base || '_to_' || lang || '.pt' END AS checkpoint_path,
    'checkpoints/vocab.json' AS vocab_path, 0.0001::DOUBLE AS requested_lr, CASE WHEN from_checkpoint IS NULL THEN 0.0001 ELSE 0.00005 END::DOUBLE AS effective_lr
  FROM based)"""


def oracle_sql() -> dict[str, str]:
    early = " UNION ALL ".join(
        f"""SELECT run, max(epoch) AS last_epoch, max(idle >= {p}) AS stopped, arg_min(epoch, (val_loss, epoch)) AS best_epoch, round(min(val_loss), 6) AS best_val_loss, {p} AS patience
  FROM (SELECT *, coalesce(max((idle >= {p})::INTEGER) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM counted) WHERE past = 0 GROUP BY run"""
        for p in (1, 2, 3)
    )
    return {
        "corpus_stats": f"WITH {_DOCS} SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, least(sum(length(text)), 10000000)::BIGINT AS capped_chars FROM docs GROUP BY lang",
        "corpus_split": f"""WITH {_DOCS}, cut AS (SELECT lang, off, off + length(text) AS fin, n, {_BOUNDS} FROM kept),
parts AS (
  SELECT lang, 'train' AS split, greatest(off, 0) AS lo, least(fin, a) AS hi, 0 AS base FROM cut UNION ALL
  SELECT lang, 'val', greatest(off, a), least(fin, b), a FROM cut UNION ALL SELECT lang, 'test', greatest(off, b), least(fin, n), b FROM cut)
SELECT lang, split, sum(hi - lo)::BIGINT AS n_chars, count(*) AS n_parts, sum((lo - base) % 1009)::BIGINT AS start_sum FROM parts WHERE hi > lo GROUP BY lang, split""",
        "vocab_build": f"WITH {_VOCAB} SELECT lang, ch, id FROM vocab",
        "vocab_json": f"WITH {_VOCAB} SELECT lang, ch, id, (count(*) OVER (PARTITION BY lang))::INTEGER AS vocab_size, '<unk>' AS unk FROM vocab",
        "encode_oov": f"""WITH {_VOCAB}, counts AS (SELECT lang, ch, count(*) AS k FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM kept) WHERE ch <> '' GROUP BY ALL),
langs AS (SELECT DISTINCT lang FROM counts)
SELECT s.lang AS src, c.lang AS tgt, sum(k)::BIGINT AS n_chars, sum(CASE WHEN v.ch IS NULL THEN k ELSE 0 END)::BIGINT AS n_unk,
  round(sum(CASE WHEN v.ch IS NULL THEN k ELSE 0 END)::DOUBLE / sum(k), 6) AS unk_rate
FROM counts c JOIN langs s ON true LEFT JOIN known v ON v.lang = s.lang AND v.ch = c.ch GROUP BY ALL""",
        "vocab_overlap": f"""WITH {_VOCAB}, sizes AS (SELECT lang, count(*) AS k FROM known GROUP BY lang)
SELECT a.lang AS a, b.lang AS b, count(*) AS shared, any_value(x.k) - count(*) AS only_a, any_value(y.k) - count(*) AS only_b
FROM known a JOIN known b ON a.ch = b.ch AND a.lang < b.lang JOIN sizes x ON x.lang = a.lang JOIN sizes y ON y.lang = b.lang GROUP BY a.lang, b.lang""",
        "next_char_windows": f"""WITH {_CHARS}, coded AS (SELECT s.lang, s.split, s.i, s.m, v.id FROM split s JOIN vocab v USING (lang, ch)),
framed AS (
  SELECT lang, split, i, m, sum(id) OVER w AS x, sum(id * i) OVER w AS xi, lead(id, 16) OVER (PARTITION BY lang, split ORDER BY i) AS nxt, id
  FROM coded WINDOW w AS (PARTITION BY lang, split ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING))
SELECT lang, split, (i // 64)::BIGINT AS batch_id, count(*) AS n, sum(x)::BIGINT AS x_sum, sum(xi - (i - 1) * x)::BIGINT AS x_dot, sum(x - id + nxt)::BIGINT AS y_sum
FROM framed WHERE i < m - 16 GROUP BY ALL""",
        "dataset_lengths": f"WITH {_SIZES} SELECT lang, split, n_chars, greatest(0, n_chars - 100)::BIGINT AS samples FROM sizes",
        "batch_plan": f"""WITH {_SIZES}, s AS (SELECT lang, split, batch_size, greatest(0, n_chars - 100)::BIGINT AS samples FROM sizes, (VALUES (64), (256)) v(batch_size))
SELECT lang, split, batch_size, samples, (samples + batch_size - 1) // batch_size AS batches,
  CASE WHEN samples > 0 THEN samples - batch_size * ((samples + batch_size - 1) // batch_size - 1) ELSE 0 END AS last_batch FROM s""",
        "eval_loss": "SELECT src AS lang, loss, ppl FROM (" + _transfer("s.lang = t.lang") + ")",
        "transfer_matrix": _transfer("true"),
        "manifest_balance": f"""WITH {_DOCS}, t AS (SELECT lang, sum(length(text))::BIGINT AS total FROM docs GROUP BY lang), l AS (SELECT min(total) AS least FROM t),
p AS (SELECT lang, length(text) AS len, off, least, total FROM offs JOIN t USING (lang), l WHERE off < least AND length(text) > 0)
SELECT lang, max(total) AS n_chars, sum(least(len, least - off))::BIGINT AS kept_chars, count(*) AS kept_docs FROM p GROUP BY lang""",
        "train_loss_windows": f"""WITH {_STEPS} SELECT run, epoch, global_step, n_steps, round(m, 6) AS train_loss, round(exp(m), 6) AS train_ppl, round(g, 6) AS grad_norm FROM flushed""",
        "epoch_summary": f"""WITH {_STEPS} SELECT run, epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, round(best, 6) AS best_val_loss,
  round(exp(train_loss), 6) AS train_ppl, round(exp(val_loss), 6) AS val_ppl, 0.0001::DOUBLE AS learning_rate, idle AS epochs_no_improve FROM counted""",
        "early_stopping": f"WITH {_STEPS} {early}",
        "metric_log": f"""WITH {_STEPS}
SELECT run, 'train' AS kind, epoch::DOUBLE AS epoch, global_step::DOUBLE AS global_step, round(m, 6) AS loss, round(exp(m), 6) AS ppl, round(g, 6) AS grad_norm, 0.0001::DOUBLE AS learning_rate,
  NULL::DOUBLE AS best_val_loss, NULL::DOUBLE AS epochs_no_improve FROM flushed UNION ALL
SELECT run, 'val', epoch, global_step, round(val_loss, 6), round(exp(val_loss), 6), NULL, NULL, round(best, 6), lag(idle, 1, 0) OVER (PARTITION BY run ORDER BY epoch)
  FROM (SELECT *, coalesce(max((idle >= 1)::INTEGER) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM counted) UNION ALL
SELECT run, 'test', NULL, NULL, round(min(val_loss), 6), round(exp(min(val_loss)), 6), NULL, NULL, NULL, NULL FROM counted GROUP BY run""",
        "convergence_auc": f"""WITH {_STEPS}, areas AS (SELECT run, (val_loss + lead(val_loss) OVER (PARTITION BY run ORDER BY epoch)) / 2 AS area FROM epochs)
SELECT run, count(*) AS n_epochs, round(coalesce(sum(area), 0.0), 6) AS auc FROM areas GROUP BY run""",
        "grad_norm": """WITH g AS (SELECT label AS param, sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS s FROM embeddings GROUP BY label), t AS (SELECT sqrt(sum(s)) AS total FROM g)
SELECT param, round(sqrt(s), 6) AS param_norm, round(total, 6) AS total_norm, round(least(1.0, 1.0 / (total + 1e-6)), 9) AS clip_factor FROM g, t""",
        "run_registry": f"WITH {_registry()} SELECT * FROM registry",
        "next_version": f"""WITH {_registry()}, existing(path) AS (VALUES {_values([(p,) for p in _EXISTING])}),
tries AS (SELECT DISTINCT checkpoint_path AS base, i, CASE WHEN i = 0 THEN checkpoint_path ELSE regexp_replace(checkpoint_path, '\\.pt$', '.ft' || i || '.pt') END AS path
  FROM registry, range(0, {len(_EXISTING) + 2}) r(i))
SELECT base, arg_min(path, i) AS path FROM tries WHERE path NOT IN (SELECT path FROM existing) GROUP BY base""",
        "model_params": f"WITH {_VOCAB} SELECT lang, count(*) AS vocab_size, 11::BIGINT AS n_tensors, (385 * count(*) + 921600)::BIGINT AS n_params FROM vocab GROUP BY lang",
    }
