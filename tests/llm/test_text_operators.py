import hashlib
import html
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import imatch, mincut, packing, pieces, rules, toxicity, winnow
from plumbline.llm.queries import ORACLE_SQL, table, tokenizer

EDGE = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "b c"), (None, "x y"), (4, "é " * 20_000)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_and_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, known = table(spark, sf, "documents"), table(spark, sf, "labels")
    y = {r.doc_id: r for r in known.collect()}
    for run, label, least in ((rules.quality, "quality", 0.98), (toxicity.toxicity, "toxic", 0.95)):
        got = run(docs, known).collect()
        assert len(got) == docs.count()
        held = [r for r in got if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
        assert all(r.held_out for r in held)
        assert sum(r.predicted == y[r.doc_id][label] for r in held) / len(held) >= least
        if label == "toxic":
            toxic, called = [r for r in held if y[r.doc_id].toxic == 1], [r for r in held if r.predicted == 1]
            assert sum(r.predicted for r in toxic) / len(toxic) >= 0.9 and sum(y[r.doc_id].toxic for r in called) / len(called) >= 0.95


@pytest.mark.parametrize("run", [rules.quality, toxicity.toxicity])
def test_classifiers_on_edges(spark, docs_of, run):
    for rows in ([], [(1, 0, 1), (2, None, None), (3, 1, 0), (3, 0, 1), (None, 1, 1)]):
        got = run(docs_of(EDGE), labels(spark, rows)).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert run(docs_of([]), labels(spark, [])).count() == 0


def test_compiled_rules_agree(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((500, len(rules.STATS)))
    model = rules.fit(x, (x[:, 2] > 0.5) & (x[:, 3] < 0.7))
    df = spark.createDataFrame([(v.tolist(),) for v in x[:50]], "stats array<double>")
    got = [r[0] for r in df.select(model.column(df.stats)).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-model.margin(x[:50]))))


def test_line_dedup_against_sql(spark, docs_of, tmp_path):
    rng = random.Random(2)
    lines = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 30))) for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 14)))) for i in range(60)] + [(60, None), (61, "")]
    docs_of(rows).select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    want = {r[0]: r[1:] for r in duck.execute("select doc_id, text, n_lines, n_removed from (" + winnow.SQL.replace("{w}", "20") + ")").fetchall()}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in winnow.dedup_lines(docs_of(rows), 20).collect()}
    assert got == want and sum(x[2] for x in got.values())
    assert "python" not in winnow.dedup_lines(docs_of(rows), 20)._jdf.queryExecution().toString().lower()


def test_line_dedup_edges(docs_of):
    passage = " ".join(f"p{i}" for i in range(55))
    got = {r.doc_id: r.text for r in winnow.dedup_lines(docs_of([(1, f"a\n{passage}"), (2, f"b\n{passage} \nc"), (None, passage), (3, passage[:20])])).collect()}
    assert got == {1: f"a\n{passage}", 2: "b\nc", None: passage, 3: passage[:20]}
    assert len(winnow.dedup_lines(docs_of(EDGE)).collect()) == len(EDGE)
    assert winnow.dedup_lines(docs_of([])).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    df = spark.createDataFrame([(1, f"a\n{passage}", "k1", "r1", 7, "x.1", "w"), (2, f"b\n{passage}", "k2", "r2", 8, "x.2", "v")], "doc_id long, text string, left string, runs string, n_lines long, `a.b` string, row string")
    out = winnow.dedup_lines(df, keep=["left", "runs", "n_lines", "a.b", "row", "text"])
    assert out.columns == ["left", "runs", "a.b", "row", "doc_id", "text", "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [("k1", "r1", "x.1", "w", 1, f"a\n{passage}", 2, 0), ("k2", "r2", "x.2", "v", 2, "b", 2, 1)]


def test_winnowing_selects_few_positions(docs_of):
    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randrange(4, 12))) for _ in range(60))) for i in range(20)]
    lines = winnow.numbered(docs_of(rows).select("doc_id", "text"), 50)
    marks = winnow.fingerprints(lines)
    assert 0 < marks.count() < 0.45 * lines.count()
    assert marks.select(F.explode("windows")).count() == lines.where("window is not null").count()


def test_pieces_refuse_other_models(tmp_path):
    import sentencepiece

    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    pieces.check(tokenizer("piece_bpe_32k.model"))
    assert sentencepiece.SentencePieceProcessor(model_proto=raw).get_piece_size() == 32_000
    bad = tmp_path / "m.model"
    bad.write_bytes(raw + bytes([0x12, 2, 0x18, 1]))  # a trainer's model type of 1
    with pytest.raises(ValueError, match="not BPE"):
        pieces.check(str(bad))


def test_digests_of_nulls_and_repeated_rows(spark):
    path = tokenizer("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, [5, 6]), (1, [5, 6]), (2, None), (None, [])], "doc_id long, ids array<int>")
    got = pieces.digests(df, path).collect()
    assert sorted((r.doc_id or -1, r.n_ids) for r in got) == [(-1, 0), (1, 2), (1, 2), (2, 0)]
    assert all(r.n_chars == 0 and r.text_md5 == hashlib.md5(b"").hexdigest() for r in got if not r.n_ids)


def test_pieces_round_trip(docs_of):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices(list("  \n\tabsdthe.!é世’<>0x"), k=rng.randrange(50)))) for i in range(300)] + EDGE
    ids = pieces.encode(docs_of(rows), path)
    got = sorted(((r.doc_id or -1), r.ids) for r in ids.collect())
    assert got == sorted(((i or -1), model.encode(t or "")) for i, t in rows)
    assert sorted((r.doc_id or -1, r.text) for r in pieces.decode(ids, path).collect()) == sorted((i or -1, t or "") for i, t in rows)
    assert pieces.encode(docs_of([]), path).count() == 0


def brute_fingerprints(rows, high):
    """Of each document its fingerprint and its likeness to the next one's, by loops over words."""
    import numpy as np

    from plumbline.llm.hashing import U, mix, mix_int, word_hashes

    number = lambda w: int(word_hashes([w.encode()])[0][0])
    mixed = lambda x: int(mix(np.array([x & (1 << 64) - 1], U))[0])
    words = {i: sorted({number(w) for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())}) for i, t in rows}
    times = {}
    for ws in words.values():
        for w in ws:
            times[w] = times.get(w, 0) + 1
    lexicon = {w for w, n in times.items() if imatch.LOW <= n / len(rows) <= high}
    found = {}
    for i, ws in words.items():
        inside = [w for w in ws if w in lexicon]
        some = inside or ws
        codes = [[0] * imatch.REPLICAS for _ in imatch.SHARES]
        for level, share in enumerate(imatch.SHARES):
            for r in range(imatch.REPLICAS):
                kept = [w for w in inside if mixed(w ^ mix_int(r)) < int(share * 2.0**64)]
                codes[level][r] = mixed(sum(map(mixed, kept))) % 65535 + 1 if kept else 0
        found[i] = (mixed(sum(map(mixed, some)) + len(some)), codes)

    def like(a, b):
        if a == b:
            return 1.0
        told = [[x > 0 or y > 0 for x, y in zip(p, q, strict=True)] for p, q in zip(a[1], b[1], strict=True)]
        level = max((k for k, t in enumerate(told) if 2 * sum(t) >= imatch.REPLICAS), default=0)
        agree = sum(x == y and x > 0 for x, y in zip(a[1][level], b[1][level], strict=True))
        return agree / max(1, sum(told[level]))

    order = sorted(found)
    text = lambda f: f"{f[0]:016x}" + "".join(f"{c:04x}" for level in f[1] for c in level)
    return {i: (text(found[i]), like(found[i], found[order[(k + 1) % len(order)]])) for k, i in enumerate(order)}


def test_fingerprints_of_many_rows_of_one_id(docs_of):
    rows = [(7, f"text number {i} of the same id") for i in range(60)] + [(i, f"other {i}") for i in range(10, 30)] + [(None, f"none {i}") for i in range(20)]
    for terms in (imatch.MAX_TERMS, 5):
        got = imatch.fingerprints(docs_of(rows), max_terms=terms).collect()
        assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((i or -1, len(t)) for i, t in rows)
        last = next(r for r in got if r.doc_id == 29)
        nones = {hashlib.sha256(imatch.edited("other 29", t).encode()).hexdigest() for i, t in rows if i is None}
        assert last.edited_sha256 in nones  # after the last the first, a null id


def test_fingerprints(docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 200)))) for i in range(80)] + [(80, None), (81, "one"), (82, "one")]
    got = {r.doc_id: r for r in imatch.fingerprints(docs_of(rows), high=1.0).collect()}
    text = {i: t or "" for i, t in rows}
    for i, t in text.items():
        n = len(t) // 4
        new = t[: len(t) - n] + text[(i + 1) % len(text)][:n] if n else t
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert got[81].fingerprint == got[82].fingerprint and got[81].near_next == 1
    some = [r for i, r in got.items() if len(text[i]) > 300]
    assert sum(r.near_edited > r.near_next for r in some) > 0.8 * len(some)
    assert brute_fingerprints(rows, 1.0) == {i: (r.fingerprint, r.near_next) for i, r in got.items()}
    assert imatch.fingerprints(docs_of(EDGE)).count() == len(EDGE)
    assert imatch.fingerprints(docs_of([])).count() == 0


def test_main_text(spark):
    got = mincut.main_text(table(spark, "/root/testdata/sf0.001", "pages")).collect()
    pages = {r.page_id: r.html for r in table(spark, "/root/testdata/sf0.001", "pages").collect()}
    for r in got:
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    right = total = 0
    for page, content in mincut._made_up(80, 77):
        there = {b.text for b in mincut.blocks(page)}
        found, wanted = set(mincut.extract(page).split("\n")) - {""}, content & there
        right, total = right + len(found & wanted), total + len(found | wanted)
    assert right / total > 0.93
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>a b c d."), (2, "u", "<a" * 3000), (3, "u", "<p>" * 3000)], "page_id long, url string, html string")
    assert mincut.main_text(odd).count() == 5


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randrange(1, 8)
        supply = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda keep, supply=supply, edges=edges: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(supply, keep, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])
        best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert cost(mincut.minimum_cut(supply, edges)) == pytest.approx(best)


def test_packing(spark, docs_of):
    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices(list(" '\n\tabsdtre.!é世the"), k=rng.randrange(6000)))) for i in range(120)] + [(900, None), (901, ""), (None, "x"), (902, "it's we'll  \n 's")]
    got = packing.pack(docs_of(rows), path).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padded = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padded += packing.padding(at)
    assert padded < 0.01 * sum(r.length for r in got)
    assert packing.pack(docs_of([]), path).count() == 0


def test_added_tokens_in_a_text(docs_of):
    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "no <|endoftext| here", " <|endoftext|>\n\n<|endoftext|>", "it's<|endoftext|>'s  "]
    for r in packing.pack(docs_of(list(enumerate(texts))), path).collect():
        ids = np.array([*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_cutting_stock_covers_everything():
    rng = random.Random(8)
    for n in (1, 7, 400):
        h = {}
        for _ in range(n):
            r = rng.choice([700, rng.randrange(1, 1024)])
            h[r] = h.get(r, 0) + 1
        plan = packing.solve(h, gain=1e-3)
        places = packing.Assigner(plan)
        used = {}
        for r, k in h.items():
            for i in range(k):
                for length, sequence, offset, _ in places.pieces(r, i):
                    used.setdefault(sequence, []).append((offset, length))
        for v in used.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= 1024
        assert set(used) == set(range(places.sequences))


def test_oracles_are_registered():
    assert set(ORACLE_SQL) == {"op3_line_dedup", "op7_exact_top_k", "op10_sharding"}


def test_toxicity_reads_the_whole_text():
    import numpy as np

    rng = random.Random(12)
    noise = ["".join(rng.choices("bdfgknprstvz", k=6)) for _ in range(300)]

    def text(k):
        words = rng.choices(noise, k=60)
        for place, word in zip(rng.sample(range(0, 60, 12), k), rng.sample(["achlor", "achlim", "achlen", "achlut"], k), strict=True):
            words[place] = word  # never two of them in one window
        return " ".join(words)

    counts = [4 if i % 4 == 0 else int(i % 10 == 1) for i in range(600)]
    model = toxicity.fit([text(k) for k in counts], np.array([k == 4 for k in counts]))
    many, one = (model.scores([text(k) for _ in range(100)]) for k in (4, 1))
    assert (many[:, None] > one[None, :]).mean() > 0.95


def test_article_content_of_all_kinds_stays():
    page = (
        "<html><head><title>x</title><body><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><article class='qz-1'><header><h1>The title</h1></header>"
        "<p>Some text here that is long enough to tell.</p><ul><li><a>linked item</a></li><li><a>other one</a></li></ul><p>More | text | follows it now.</p>"
        "<table><tr><td>a cell</td><td>b</td></tr></table><pre>code = 1</pre><math><mi>x</mi></math><aside><p>Buy this now.</p></aside></article><footer>&copy; us</footer>"
    )
    want = ["The title", "Some text here that is long enough to tell.", "linked item", "other one", "More | text | follows it now.", "a cell", "b", "code = 1", "x"]
    assert mincut.extract(page).split("\n") == want
    bare = "<title>q</title><head><meta name=x><p>Hello there, this is a page without a body tag.<p>And more text is here, too."
    assert mincut.extract(bare) == "Hello there, this is a page without a body tag.\nAnd more text is here, too."
    unknown = "<body><aside class='kq'><p>Read this other thing.</p></aside><main id='zzk'><p>What the page is about stands here.</p><h2>Part</h2><p>And goes on.</p></main><footer class='mm'>All rights kept.</footer>"
    assert mincut.extract(unknown) == "What the page is about stands here.\nPart\nAnd goes on."


def test_long_pages_take_time_in_proportion():
    import time

    page = "<article>" + "".join(f"<p>Sentence number {i} stands here with some words.</p><div class='ad'><a href=x>Buy {i}</a></div>" for i in range(100_000)) + "</article>"
    began = time.time()
    out = mincut.extract(page).split("\n")
    assert len(out) == 100_000 and time.time() - began < 60
