import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from archivemill.llm import op12_language as op
from archivemill.llm import tokens

SF = "/root/testdata/sf0.01"


def plain(network, run):
    """Log probabilities of one run, place by place, as the unit's formulas say."""

    def states(direction, data):
        n, h, out = direction.hidden, np.zeros(direction.hidden), []
        for byte in data:
            x, own = direction.inputs[byte] + direction.bias, h @ direction.states
            z, r = (1 / (1 + np.exp(-(x[k * n : k * n + n] + own[k * n : k * n + n]))) for k in (0, 1))
            new = np.tanh(x[2 * n :] + r * own[2 * n :])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    there, back = states(network.there, run), states(network.back, run[::-1])[::-1]
    rows = np.array([np.r_[a, b] @ network.out + network.prior for a, b in zip(there, back, strict=True)])
    return rows - np.log(np.exp(rows).sum(axis=1, keepdims=True))


def test_the_network_follows_its_formulas():
    network = op.Network(["a", "b", "c"], hidden=5, kind=np.float64)
    for run in (b"x", b"running", "né".encode()):
        data = np.frombuffer(run, np.uint8)[None, :]
        assert np.allclose(network.logs(data)[1][:, 0], plain(network, run))


def test_backpropagation_equals_differences():
    network = op.Network(["a", "b", "c"], hidden=4, kind=np.float64)
    pick = np.random.default_rng(3)
    data, label, weight = pick.integers(97, 103, (6, 5)).astype(np.uint8), pick.integers(0, 3, 6), pick.random(6)
    _, slopes = network.slopes(data, label, weight)
    for w, slope in zip(network.weights(), slopes, strict=True):
        for place in [tuple(pick.integers(0, s) for s in w.shape) for _ in range(12)] + [(99, 2)] * (len(w) == 256):
            old, ends = w[place], []
            for step in (1e-5, -1e-5):
                w[place] = old + step
                ends.append(network.slopes(data, label, weight)[0])
            w[place] = old
            assert np.isclose((ends[0] - ends[1]) / 2e-5, slope[place], atol=1e-6)


def test_pooling_covers_whole_texts(monkeypatch):
    monkeypatch.setattr(op, "KEPT_RUNS", 10)  # so that the kept runs are dropped at times
    network = op.Network(["a", "b"])
    reader, wanted = op.Reader(network), []
    texts = ["Hello hello, world", "", "x" * 100 + "9", "…", "one TWO three " * 300]
    for text in texts:
        runs = [w[i : i + op.LONGEST] for w in tokens_of(text) for i in range(0, len(w), op.LONGEST)]
        logs = np.concatenate([plain(network, r) for r in runs]) if runs else np.zeros((1, 2))
        share = np.exp(logs.mean(axis=0))
        wanted.append(share / share.sum())
    for part in (texts, texts[::-1]):
        found = np.concatenate([op.pooled(t, reader)[0] for t in tokens.slices(pa.array(part), limit=50)])
        assert np.allclose(found, wanted if part is texts else wanted[::-1], atol=1e-4)


def tokens_of(text):
    out, run = [], b""
    for byte in text.encode() + b" ":
        if op.LETTERS[byte]:
            run += bytes([byte + 32 if 65 <= byte <= 90 else byte])
        elif run:
            out.append(run)
            run = b""
    return out


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = op.train(docs)
    rows = op.languages(docs, network).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = [r.lang_pred == r.lang for r in rows if r.lang]
    assert len(right) > 150 and sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    # The label, the source and rows held out do not matter.
    blind = docs.withColumn("lang", F.when(op.held_out(docs["doc_id"]), "xx").otherwise(F.col("lang"))).drop("source")
    again = op.train(blind)
    assert all((a == b).all() for a, b in zip(network.weights(), again.weights(), strict=True))


def test_odd_rows(spark, odd):
    learn = [(i, t, la) for i in range(40) for t, la in [("the cat sat on the mat", "en"), ("der Hund läuft über die Straße", "de")]]
    learn += [(1000, "nothing", None), (1001, None, "zz"), (None, "rien", "fr"), (1002, "", "zz")]
    network = op.train(spark.createDataFrame(learn, "doc_id bigint, text string, lang string"), most_docs=30)
    assert network.languages == ["de", "en", "zz"]
    rows = {r.doc_id: r for r in op.languages(odd, network).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[0].score == 0 and rows[None].held_out is False
    assert op.languages(odd, network).count() == odd.count() and op.languages(odd.limit(0), network).count() == 0
    texts = [(1, "the mat"), (2, "über die"), (3, "123 ... 🙂"), (4, "THE CAT sat")]
    found = op.languages(spark.createDataFrame(texts, "doc_id int, text string"), network).collect()
    assert [r.lang_pred for r in found] == ["en", "de", "und", "en"]
    none = op.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert none.languages == [] and {r.lang_pred for r in op.languages(odd, none).collect()} == {"und"}
