"""Sampling, packing, language-model scores, the quality classifier and rules, HTML extraction and the pipeline."""

import html
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardstone.llm import piece_sampling, queries
from wardstone.llm.html_extract import Page, extract_pages
from wardstone.llm.lattice import MARKER, forward, vocabulary
from wardstone.llm.lattice_batch import log_marginals
from wardstone.llm.lm_scoring import lm_scores
from wardstone.llm.packing import Encoder, best_fit_packing, plan
from wardstone.llm.piece_sampling import Sampler, decode_pieces, sample_pieces
from wardstone.llm.quality_model import fit, score_quality, statistics
from wardstone.llm.quality_rules import quality_rules

LONG = "very long text without an end " * 4000
ROWS = [(1, "Hello world"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "x" * 5000), (7, "▁ literal ▁▁ é漢😀"), (1, "Hello world"), (None, "Hello world"), (8, "a <|endoftext|> b")]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("pieces", "score", "id", "t", "word", "piece", "length", "held_out", "n_chars", "host"))))


def segmentations(word):
    def back(j):
        if j == 0:
            yield ()
            return
        for i, ids in vocabulary().ending(word, j):
            for rest in back(i):
                yield rest + ids

    return list(back(len(word)))


@pytest.mark.parametrize("word", ["the", "hello", "été漢x", "a▁b"])
def test_lattice_sums(word):
    vocab, weight = vocabulary(), np.array(vocabulary().weight)
    each = [math.exp(sum(vocab.weight[x] for x in s)) for s in segmentations(MARKER + word)]
    assert math.isclose(forward(vocab, MARKER + word, vocab.weight)[-1], math.log(sum(each)))
    assert math.isclose(log_marginals([word, "other"], weight)[0], math.log(sum(each)))


def test_long_words_equal_short_ones():
    word, weight = "abcé漢the▁x" * 25, np.array(vocabulary().weight)
    assert math.isclose(log_marginals([word], weight)[0], forward(vocabulary(), MARKER + word, weight.tolist())[-1])
    assert math.isfinite(log_marginals(["the" * 100_000], weight)[0])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abc the\n\t▁é漢😀", max_size=40), min_size=1, max_size=5))
def test_samples_are_lossless_and_repeatable(texts):
    sampler, vocab = Sampler(None, 0.5), vocabulary()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    together = sampler(texts, list(range(len(texts))))
    for i, (text, ids) in enumerate(zip(texts, together)):
        assert vocab.decode(ids.tolist()) == text and (sampler([text], [i])[0] == ids).all()
        if "▁" not in text:
            assert model.decode(ids.tolist()) == text


def test_samples_follow_the_lattice():
    weight = vocabulary().weight
    share = {s: math.exp(0.5 * sum(weight[x] for x in s)) for s in segmentations(MARKER + "hello")}
    got = Counter(tuple(x.tolist()) for x in Sampler(None, 0.5)(["hello"] * 20_000, list(range(20_000))))
    assert all(abs(got[s] / 20_000 - w / sum(share.values())) < 0.02 for s, w in share.items())


def test_long_words_are_sampled_as_short_ones(monkeypatch):
    """Words that are too long for a matrix give the same pieces for the same draws, so they follow the same distribution."""
    texts = ["hello world", "été漢x a▁b unbelievable", "internationalisation of the " * 3]
    want = [Sampler(None, 0.5)([t] * 50, list(range(50))) for t in texts]
    monkeypatch.setattr(piece_sampling, "LONG", 1)
    for t, each in zip(texts, want):
        assert all((a == b).all() for a, b in zip(Sampler(None, 0.5)([t] * 50, list(range(50))), each))


def test_sampling_rows(spark):
    rows = decode_pieces(sample_pieces(frame(spark))).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in rows) and len(rows) == len(ROWS)
    same = [tuple(r["pieces"]) for r in rows if r["doc_id"] == 1]
    assert same[0] == same[1] and all(not r["pieces"] for r in rows if not r["text"])
    assert sample_pieces(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab Z09 \n\t\r\x0b\x1c\x85\xa0　'sét漢😀!,.#", max_size=40))
def test_encoder_equals_tokenizer(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in (text, text + "<|endoftext|>" + text):
        ids = np.frombuffer(Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))(t), "<u4").tolist()
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids


def brute_pieces(texts, capacity):
    """(id, piece, start, length, crc32) of each piece of (id, text) rows."""
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for d, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        start, first = 0, len(ids) % capacity or capacity
        for i, n in enumerate([first] + [capacity] * ((len(ids) - first) // capacity)):
            out.append((str(d), i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
            start += n
    return out


def check_packing(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts}
    held: dict = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == capacity
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids[d]) for d, _ in texts)
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(spark):
    rng = random.Random(1)
    rows = [*ROWS, *((100 + i, "word " * rng.randint(0, 60)) for i in range(200))]
    used, bound = check_packing(best_fit_packing(frame(spark, rows), capacity=64).collect(), rows, 64)
    assert used <= bound * 1.02 + 1
    assert best_fit_packing(frame(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), min_size=1))
def test_plan_places_each_piece_once(counts):
    room, placed = Counter(), Counter()
    for length, first, ranks, each, sequence, offset in plan(counts, 32):
        for rank in range(ranks):
            s, o = sequence + rank // each, offset + rank % each * length
            assert o + length <= 32
            room[s] += length
            placed[length, first + rank] += 1
    assert max(room.values()) <= 32 and placed == Counter({(n, r): 1 for n, c in counts.items() for r in range(c)})


def test_lm_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = lm_scores(docs, head=500).toPandas().set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id")["text"]
    words = {d: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w] for d, t in texts.items()}
    train, ends = Counter(), 0
    for d, ws in words.items():
        if zlib.crc32(str(d).encode()) % 10:
            train.update(ws)
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    for d, ws in words.items():
        row = got.loc[d]
        assert row["n_tokens"] == len(ws) + 1 and row["n_known"] == sum(w in train for w in ws) + 1 and row["train_tokens"] == n
        assert row["held_out"] == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert math.isclose(row["base_score"], sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(train[w] for w in ws), ends]), rel_tol=1e-9)
    full = lm_scores(docs, head=10**6).toPandas().set_index("doc_id")
    assert np.allclose(full["score"].sort_index(), got["score"].sort_index())  # the head changes nothing
    weight, end = vocabulary().weight, (ends + 0.5) / (n + 1)
    few = sorted((d for d in words if 0 < len(words[d])), key=lambda d: sum(map(len, words[d])))[:20]
    for d in few:
        marginals = [forward(vocabulary(), MARKER + w, weight)[-1] for w in words[d]]
        assert math.isclose(got.loc[d]["score"], (sum(marginals) + len(marginals) * math.log1p(-end) + math.log(end)) / math.log(10), rel_tol=1e-9)


def test_lm_score_equals_enumeration(spark):
    """The score is the end's share times, for each word, its share and the sum over every segmentation of the vocabulary's weights."""
    rows, weight = [(1, "the cat"), (2, "A▁b été"), (3, "hello\thello 漢x"), (5, "")], vocabulary().weight
    train = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 10]
    n, got = sum(len((t or "").split()) + 1 for d, t in rows if d in train), {r["doc_id"]: r for r in lm_scores(frame(spark, rows)).collect()}
    end = (len(train) + 0.5) / (n + 1)
    for d, text in rows:
        each = [sum(math.exp(sum(weight[x] for x in s)) for s in segmentations(MARKER + w)) for w in text.lower().split()]
        assert math.isclose(got[d]["score"], math.log10(end) + sum(math.log10((1 - end) * p) for p in each), rel_tol=1e-9)


def test_lm_scores_edges(spark):
    got = lm_scores(frame(spark)).collect()
    assert len(got) == len(ROWS) and all(math.isfinite(r["score"]) for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)] == [1, 1, 1] and [r["n_tokens"] for r in got if r["doc_id"] == 1] == [3, 3]
    assert lm_scores(frame(spark, [])).count() == 0


def test_quality_model(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean() > 0.85
    edge = score_quality(frame(spark), labels.limit(0)).collect()
    assert len(edge) == len(ROWS) and {r["score"] for r in edge} == {0.5}
    assert score_quality(frame(spark, []), labels).count() == 0


def test_trees_fit_a_step():
    x = np.random.default_rng(0).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((fit(x, y).score(x) > 0.5) == y).mean() > 0.97
    assert fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5] and len(statistics("")) == len(statistics(LONG))


def test_quality_rules(spark):
    rows = [*ROWS, (50, "the same words here " * 30), (51, " ".join(f"the a{i} b{i} c{i}" for i in range(40)))]
    got = {r["doc_id"]: r for r in quality_rules(frame(spark, rows)).where("doc_id is not null").collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[4]["kept"] and got[50]["base_failed"] and got[51]["kept"]
    assert got[50]["n_repeat_words"] == 120 and got[6]["word_chars"] == 5000
    assert quality_rules(frame(spark, [])).count() == 0


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><nav><ul><li>a<li>b</ul></nav><div class="content"><article class="post post-12">
<header><h1>Title &amp; more</h1><span>by me</span></header><p>One   is long &nbsp;enough.<p>Two <a href="x>y">link</a> here<br>next &lt;tag&gt;<div class=ad>Buy</div><ul><li>A<li>B</ul>
<form><label>Mail</label></form><section id="comments"><p>Nice post!</p></section></article></div><aside>Side</aside><footer>(c)</footer><script>if (a<b) { "</p>" }</script></body></html>"""


def test_extraction():
    assert Page(PAGE).text([]) == "Title & more\n\nOne is long enough.\n\nTwo link here next <tag>\n\nA\n\nB"
    assert Page("plain text").text([]) == "plain text" and Page("").text([]) == "" and Page("<!-- x").text([]) == ""
    assert Page("<p>a < b & c</p><p>open <b>x").text([]) == "a < b & c\n\nopen x"


def test_extraction_rows(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(-1, None, PAGE), (-2, "not a url", None), (-3, "http://h.example/", ""), (-4, None, "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    for few in (20_000, 0):
        got = {r["page_id"]: r for r in extract_pages(pages.unionByName(extra).withColumn("host", F.lit(1)).withColumn("paths", F.lit(2)), broadcast_hosts=few).collect()}
        assert got[-1]["text"].startswith("Title & more") and got[-2]["text"] == "" == got[-3]["text"] and got[-4]["text"] == "deep"
        for r in pages.collect():
            article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
            want = "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)) if x)
            assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    assert extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_query_equals_oracle(spark, sf, key):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(queries.SQL[key])
    got = queries.QUERIES[key](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline_of_nothing(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
