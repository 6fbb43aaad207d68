"""Token counts, packing, decontamination, line dedup, language ID, HTML: against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, html_text, language_id, line_dedup, packing, token_counts
from tidemark.llm.common import bucket_of
from tidemark.llm.queries import tokenizer_path

WORD = tokenizer_path("word_bpe_49k.json")
SPACES = "[ \t\n\r\x0b\f]+"


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- token counts -------------------------------------------------------------------------------------------------------------------


def unigram(word, scores, unknown):
    best = [(0.0, 0)]
    for k in range(1, len(word) + 1):
        options = [(best[k - 1][0] + unknown, -best[k - 1][1] - len(word[k - 1].encode()))]
        options += [(best[j][0] + scores[word[j:k]], -best[j][1] - 1) for j in range(k) if word[j:k] in scores]
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


@pytest.mark.parametrize("nodes", [600_000, 50])
def test_token_counts(spark, odd, none, docs, nodes):
    scores = token_counts.pieces_of(tokenizer_path("piece_bpe_32k.model"))
    unknown = min(scores.values()) - token_counts.UNKNOWN
    for df in (odd, docs.limit(25)):
        known = {}
        for text, n, tokens in rows(token_counts.token_counts(df.select(F.col("text").alias("doc_id"), "text"), scores, nodes)):
            own = [w for w in re.split(SPACES, text or "") if w]
            for w in own:
                if w not in known:
                    known[w] = unigram(token_counts.MARK + w, scores, unknown)
            assert (n, tokens) == (len(own), sum(known[w] for w in own))
    assert token_counts.token_counts(none, scores).count() == 0


def test_long_words_go_into_no_trie():
    scores = {"▁": -3.0, "a": -1.0, "ab": -1.2, "bab": -1.3, "b": -2.0, "é": -4.0}
    trie, rng = token_counts.Trie(scores, 1000), np.random.default_rng(3)
    for n in (3, 499, 501, 999, 1001, 3000):
        word = "".join(rng.choice(list("abé日"), n))
        assert trie.tokens(word) == unigram(word, scores, trie.unknown) and len(trie.score) <= 1000
    assert trie.tokens("ab" * 50_000) > 0 and len(trie.score) <= 1000 and len(trie.next) <= 1000


def test_token_counts_are_the_library_unigrams():
    from tokenizers import Tokenizer, models

    scores = token_counts.pieces_of(tokenizer_path("piece_bpe_32k.model"))
    model = Tokenizer(models.Unigram([("<unk>", -50.0), *scores.items()], unk_id=0, byte_fallback=False))
    trie = token_counts.Trie(scores)
    for word in ("▁the", "▁unbelievable", "▁tokenization", "▁aaaaaaa", "▁été"):
        assert trie.tokens(word) == len(model.encode(word).ids)


# --- packing ------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def checked_packing(df, found, tokenizer, capacity):
    wanted = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            wanted[r.doc_id, n, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@pytest.mark.parametrize("per_task", [100_000, 12])
def test_packing(spark, odd, none, docs, tokenizer, per_task):
    for df in (odd, docs):
        found = packing.sequences(df, WORD, per_task=per_task, fan_in=3).collect()
        bins = checked_packing(df, found, tokenizer, 4096)
        least = -(-sum(r.length for r in found) // 4096)
        assert len(bins) <= least * 1.15 + 2
    assert packing.sequences(none, WORD).count() == 0


def test_ids_are_the_tokenizers(tokenizer):
    import random

    import pyarrow as pa

    rng = random.Random(5)
    pools = ["".join(map(chr, range(1, 0x250))), "abcdefghij'.,! ", "日本語テキスト漢字 ", "ёжикЯ İıſK\u0301 \u0308  \x1c\x85", "αΣςσΩ Ω"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 15))) for _ in range(8000)]
    texts += [rng.choice(["word", "Straße", "İİ", "été", "x"]) + rng.choice([".", ",", "?!", "...", "'s", "%%%", ""]) for _ in range(500)]
    texts += ["Əli", "Ɓala", "Ɔda", "Ɗan", "<|endoftext|>", "a<|startoftext|>b", "x <|startoftext|> y", None]
    for path in (WORD, tokenizer_path("byte_bpe_50k.json")):  # the second has tokens that begin with a space
        tokens = packing.Tokens(path)
        assert tokens.by_word == (path == WORD)
        for _ in range(2):  # the second time with what was remembered
            assert [
                np.frombuffer(x, "<u4").tolist() for x in tokens.encode(pa.array(texts))
            ] == [tokens.full.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_small_capacity_merges_up_the_tree(spark, tokenizer):
    df = spark.createDataFrame([(k, "a " * (k % 9)) for k in range(120)], "doc_id long, text string")
    found = packing.sequences(df, WORD, capacity=10, per_task=10, fan_in=2).collect()
    bins = checked_packing(df, found, tokenizer, 10)
    assert len(bins) <= -(-sum(r.length for r in found) // 10) * 1.2


def test_best_fit_leaves_no_two_bins_that_fit():
    lengths = np.random.default_rng(1).integers(1, 101, 3000)
    bins = packing.best_fit(lengths, 100)
    fill = np.sort(np.bincount(bins, lengths))
    assert fill.max() <= 100 and fill[0] + fill[1] > 100


# --- decontamination ----------------------------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block", [2_000_000, 30_000])
def test_decontamination(spark, odd, none, docs, block):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = spark.createDataFrame(
        [(900, "alpha beta"), (901, None), (902, "?!"), (903, "Été"), (903, "Été"), (None, "gamma delta")], "item_id long, text string"
    )
    items = bench.unionByName(extra)
    windows = defaultdict(set)
    for r in items.collect():
        own = words(r.text)
        for k in range(max(1, len(own) - 12)):
            if own:
                windows[tuple(own[k : k + 13])].add(r.item_id)
    lengths = {len(w) for w in windows}
    for df in (odd, docs):
        got = decontamination.contamination(df.select(F.struct("doc_id", "text").alias("doc_id"), "text"), items, block_chars=block).collect()
        assert len(got) == df.count()
        for r in got:
            own, hit, found = words(r.doc_id.text), set(), set()
            for n in lengths:
                for k in range(len(own) - n + 1):
                    if (ids := windows.get(tuple(own[k : k + n]))) is not None:
                        hit |= set(range(k, k + n))
                        found |= ids
            assert (r.n_words, r.n_hit, r["items"]) == (len(own), len(hit), sorted(str(i) for i in found if i is not None))
            spelled = [w for s in r.spans for w in words(r.doc_id.text[s.start : s.end])]
            assert spelled == [own[k] for k in sorted(hit)]
    d = decontamination.digest(decontamination.contamination(odd.where("doc_id = 5"), items)).collect()
    assert {(r.n_items, r.items_sha256, r.contaminated) for r in d if r.n_items} == {(1, hashlib.sha256(b"900").hexdigest(), True)}
    kept = decontamination.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.where("text is null").count() == 2
    assert decontamination.contamination(none, items).count() == 0 and decontamination.contamination(odd, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


# --- line dedup ---------------------------------------------------------------------------------------------------------------------


def masked(line):
    spaced = re.sub("([\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff])", r" \1 ", line)
    return tuple("<*>" if re.search(r"[0-9@]|://", w) else w for w in re.split("[ \t\r\x0b\f]+", spaced) if w)


def line_templates(lines, depth=3):
    """Each line's template: the lowest of the lines that it is joined with."""
    top = {t: t for t in map(masked, lines)}
    nodes = defaultdict(list)
    for t in top:
        if len(t) >= 5:
            nodes[len(t), t[:depth]].append(t)
    for own in nodes.values():
        for _ in own:
            for a in own:
                for b in own:
                    if 5 * sum(x != y for x, y in zip(a, b)) <= len(a):
                        top[a] = top[b] = min(top[a], top[b])
    return top


def kept_lines(own, depth=3):
    top = line_templates({x for _, text in own for x in (text or "").split("\n")}, depth)
    docs = defaultdict(set)
    for doc, text in own:
        for line in (text or "").split("\n"):
            docs[top[masked(line)]].add(doc)
    stays = lambda doc, t: not t or len(docs[top[t]]) < (2 if len(t) >= 5 else 10) or min(docs[top[t]]) == doc
    return Counter((doc, None if text is None else "\n".join(x for x in text.split("\n") if stays(doc, masked(x)))) for doc, text in own)


def test_line_dedup(spark, odd, none, docs):
    for df in (odd.where("doc_id is not null"), docs):
        own = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = line_dedup.deduplicated(df)
        assert Counter((r.doc_id, r.text) for r in got.collect()) == kept_lines(own)
    out = line_dedup.without_recurring(odd)
    assert out.columns == odd.columns and "own line" in [
        r.text for r in out.where("doc_id = 13").collect()
    ] and [r.text for r in out.where("doc_id = 14").collect()] == ["unique rest of it"]
    assert out.where("text is null").count() == 2 and line_dedup.without_recurring(none).count() == 0
    clash = odd.withColumns({"__lines": F.lit("mine"), "doc": F.lit(1), "row": F.lit(2)})
    assert line_dedup.without_recurring(clash).columns == clash.columns and line_dedup.deduplicated(clash).count() == odd.count()
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {
        r.text for r in line_dedup.deduplicated(named).where("doc_id = 'd5'").collect()
    } == {r.text for r in line_dedup.deduplicated(odd).where("doc_id = 5").collect()}


def test_lines_without_spaces(spark):
    said = "この文章は複数の文書に現れる同じ行です"
    made = [(1, f"{said}\n一つ目の文書だけ"), (2, f"二つ目の文書にある別の行\n{said}"), (3, said.replace("複", "多")), (4, "ข้อความนี้ปรากฏซ้ำ"), (5, "ข้อความนี้ปรากฏซ้ำ\nok")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {1: made[0][1], 2: "二つ目の文書にある別の行", 3: "", 4: made[3][1], 5: "ok"}
    assert Counter(got.items()) == kept_lines(made)


def test_many_unlinked_lines_that_share_a_piece(spark, monkeypatch):
    """A piece that all lines have alike: rows sent grow with the lines, and the templates are those of the piece keys alone."""
    from tidemark.llm import links

    rng = np.random.default_rng(1)
    made = []
    for k in range(6_000):
        tail = [f"w{chr(97 + int(a) // 26)}{chr(97 + int(a) % 26)}" for a in rng.integers(0, 500, 4)]
        made.append((k, f"status of the job was {' '.join(['set', *tail])}"))  # ten tokens, two may differ
    made += [(30_000 + k, made[k][1].rsplit(" ", 1)[0] + " other") for k in range(50)]
    sent = []

    def counted(*how, own=links._dealt):
        out = own(*how)
        sent.append(out.count())
        return out

    monkeypatch.setattr(links, "_dealt", counted)
    parsed = line_dedup.parsed_lines(spark.createDataFrame(made, "doc_id long, text string").repartition(8))
    merged = line_dedup.merged_leaves(parsed, wide=1000)
    assert sent[0] < 20 * len(made)
    leaves = {int(r.doc): r.tid for r in parsed.select("doc", "tid").collect()}
    root = {tid: tid for tid in leaves.values()} | {r.node: r.root for r in merged.collect()}
    by = defaultdict(set)
    for k in range(50):
        assert root[leaves[k]] == root[leaves[30_000 + k]]
    texts = {leaves[k]: tuple(t.split()) for k, t in made}
    for a in list(texts)[:60]:  # all lines within two words of one are in its class
        for b, words in texts.items():
            if sum(x != y for x, y in zip(texts[a], words, strict=True)) <= 2:
                by[a].add(root[b])
        assert len(by[a]) == 1


def test_lines_with_variable_words(spark):
    """Leaves of one node are generalised, over any number of partitions; the depth of the tree decides which lines meet."""
    users = ["alice", "bobby", "carol", "dan", "erin"]
    made = [(k, f"User {u} logged in from home today\nonly {u} has this very line of text") for k, u in enumerate(users)]
    passage = [f"p{chr(97 + j)}" for j in range(26)] * 3
    made += [(10 + k, " ".join([*passage[: 9 + k], f"swap{'abcde'[k]}", *passage[10 + k :]])) for k in range(5)]
    made += [(20 + k, f"All rights reserved.\nbody of {'xyzuvwabcdef'[k]} alone") for k in range(12)]
    made += [(40, "a b c d e f g h i k"), (41, "a b c d e f g h x y"), (42, "a b c d e z w h x y"), (43, "a b c q r s t h x y")]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(7)
    for depth in (1, 3):
        got = line_dedup.deduplicated(df, depth=depth).persist()
        assert Counter((r.doc_id, r.text) for r in got.collect()) == kept_lines(made, depth)
        got = {r.doc_id: r.text for r in got.collect()}
        assert got[0] == made[0][1] and got[1] == (made[1][1] if depth == 3 else "")  # the varying word is in the head of depth 3
    assert got[10] and not any(got[10 + k] for k in range(1, 5))
    assert got[20].startswith("All rights") and got[25] == "body of w alone" and got[41] == got[42] == "" and got[43]
    said = {tuple(r.words) for r in line_dedup.templates(df.where("doc_id < 10"), depth=1).collect()}
    assert said == {("<*>", "logged", "in", "from", "home", "today"), ("<*>", "has", "this", "very", "line", "of", "text")}


# --- language ID --------------------------------------------------------------------------------------------------------------------


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    content = language_id.dictionaries(docs.where(bucket_of(F.col("doc_id")) != 0))
    assert set(content) == {"en", "de", "fr", "es"}
    held = docs.where(bucket_of(F.col("doc_id")) == 0)
    got = language_id.languages(held.select(F.struct("doc_id", "lang").alias("doc_id"), "text"), content).collect()
    assert sum(r.doc_id.lang == r.lang_pred for r in got) / len(got) > 0.98 and sum(r.rejected for r in got) / len(got) < 0.03
    assert all(0 <= r.score <= 1 for r in got)
    edge = {r.doc_id: r for r in language_id.languages(odd, content).collect()}
    assert [edge[k].lang_pred for k in (1, 2, 3, 9)] == ["und"] * 4 and edge[9].rejected
    assert language_id.keep_identified(odd, content).columns == odd.columns
    assert all(map(language_id.has_letter, ("a", "1ª", "日", "_é"))) and not any(map(language_id.has_letter, ("²½", "①", "Ⅷ", "_ 12", "")))
    many = spark.createDataFrame([(k, f"word{k % 90} " * 3, f"l{k % 90}") for k in range(180)], "doc_id long, text string, lang string")
    assert len(language_id.dictionaries(many)) == 90
    assert language_id.languages(none, content).count() == 0
    assert {r.lang_pred for r in language_id.languages(odd, language_id.dictionaries(none)).collect()} == {"und"}


def test_languages_against_plain_compression(spark, odd, docs):
    """The whole query's columns, row by row, from dictionaries that are not prepared and blocks cut by hand."""
    import zstandard

    content = language_id.dictionaries(docs.where(bucket_of(F.col("doc_id")) != 0))
    rank = {k: n for n, k in enumerate(content)}
    how = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    packers = {
        k: zstandard.ZstdCompressor(level=7, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **how) for k,
        v in content.items()
    }
    for df in (docs.limit(60), odd):
        for r in language_id.languages(df.select(F.col("text").alias("doc_id"), "text"), content).collect():
            if r.doc_id is None or not any(c.isalpha() for c in r.doc_id):
                assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
                continue
            raw = re.sub(r"[\W\d_]+", " ", r.doc_id.lower()).encode()
            blocks = [raw[k : k + 512] for k in range(0, len(raw), 512)]
            sizes = sorted((sum(len(z.compress(b)) for b in blocks), rank[k], k) for k, z in packers.items())
            bits = 8 * (sizes[1][0] - sizes[0][0]) / len(blocks)
            assert (r.lang_pred, r.rejected) == (sizes[0][2], sizes[1][0] - sizes[0][0] < 0.01 * sizes[1][0])
            assert r.score == pytest.approx(2 / (1 + 2 ** -min(bits, 60)) - 1)


def test_sizes_are_those_of_plain_compression():
    import zstandard

    content = {"a": b"one two three four five six seven", "b": b"uno due tre quattro cinque sei sette"}
    encoders = language_id.Encoders(content, 7, 512)
    text = "two three, four! FIVE"
    raw = b"two three four five"
    assert language_id.normal(text) == raw
    sizes = {
        k: len(
            zstandard.ZstdCompressor(
                level=7, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False,
                write_checksum=False, write_dict_id=False
            ).compress(raw)
        ) for k,
        v in content.items()
    }
    assert encoders(text, 0.01)[0] == min(sizes, key=sizes.get) == "a"


# --- HTML ---------------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="content"><article class="post-17"><h1>Title &amp; more</h1><p>First   paragraph of the <b>text<br>goes on.<p>Second &eacute; paragraph, which is longer than all of the menus together.</p>
<ul><li>one<li>two</ul><div class="ad">Buy!</div><section class="comments"><article><p>I disagree with all of this, said a reader at great length and with many words.</p></article></section></article></div>
<aside>side</aside><form><input><label>Name</label></form><footer>&copy; 2024</footer></body></html>"""


def test_html_text(spark, none):
    pages = spark.createDataFrame(
        [(k, "https://H.example:80/x", PAGE) for k in (1, 2)] + [
            (3, "https://h.example/y", "<html><body><div>only <i>this</i></div>"), (4, None, None), (5, "x", ""),
            (6, "https://g.example", "plain & text < 3")
        ],
        "page_id long, url string, html string"
    )
    got = {r.page_id: r for r in html_text.extracted(pages.withColumn("path", F.lit("clash")).withColumn("host", F.lit(1))).collect()}
    assert got[1].text == got[2].text == "Title & more\n\nFirst paragraph of the text goes on.\n\nSecond é paragraph, which is longer than all of the menus together.\n\none\n\ntwo"
    assert (
        got[3].text, got[4].text, got[5].text, got[6].text
    ) == ("only this", "", "", "plain & text < 3") and got[1].path.endswith(">div>article.post-N")
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_html_articles_in_parts(spark):
    intro, body, end = (" ".join([w] * n) + "." for w, n in (("intro", 33), ("body", 160), ("end", 30)))
    page = "<html><body><nav>menu</nav>{}<div class='legal'>All rights reserved.</div></body></html>"
    parts = f"<h1>Title</h1><section class='intro'><p>{intro}</p></section><section class='body'><p>{body}</p></section><section class='outro'><p>{end}</p></section>"
    table = f"<h1>Title</h1><p>{intro}</p><table><tr><td>{body}</td><td><math><mi>x</mi><annotation>x</annotation></math></td></tr></table><p>{end}</p>"
    inner = f"<h1>Title</h1><div class='text'><p>{body}</p><p>{body}</p></div>"
    pages = [
        f"<article>{parts}</article>", f"<div class='content'>{parts}</div>", f"<article>{table}</article>", f"<div class='content'>{table}</div>",
        f"<div class='content [&>p]:mt'>{inner}</div>", f"<article><div class='text'><h1>Title</h1><p>{intro}</p></div></article>"
    ]
    want = ["Title", intro, body, end]
    got = {r.page_id: r.text.split("\n\n") for r in html_text.extracted(spark.createDataFrame([(k, f"https://h{k}.example", page.format(p)) for k, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert got[0] == got[1] == want
    assert got[2] == got[3] == [*want[:3], "x", end]
    assert got[4] == ["Title", body, body] and got[5] == ["Title", intro]


def test_html_keeps_the_article():
    """Pages whose article is intact, though scripts, names and forms around it look like something else."""
    long = " ".join(["text"] * 80) + "."
    article = f"<article><h1>Title</h1><p>{long}</p></article>"
    want = f"Title\n\n{long}"
    for page in (
        f"<body><script>for(var i=0;i<n;i++){{f(i)}}</script>{article}</body>",
        f"<body><script>if (a<b) {{ s = \"don't\" }}</script>{article}</body>",
        f"<body><script><!-- x </script>{article}</body>",
        f"<body><SCRIPT>x='</scripts>'</Script >{article}</body>",
        f"<body><div class='content has-sidebar'>{article}<div class='sidebar'>links</div></div></body>",
        f"<body><div id='search-engines-explained'>{article}</div></body>",
        f"<body><div class='post tag-advertising category-social'>{article}</div></body>",
        f"<body><div class='newsletter'>{article}</div><p>x</p></body>",
        f"<body><form id=aspnetForm><nav>menu</nav>{article}<div class=ad>buy</div></form></body>",
        f"<body><p title=don't></p>{article}</body>",
        f"<body>{article}<div class=comments><p>{long}</p><p>{long}</p><p>{long}</p></div></body>",
        f"<body>{article}<form><p>Name</p></form><div style='display: none'>{long}</div></body>",
    ):
        assert html_text.text_of(page, None) == want, page
    deep = "<div>" * 60_000 + f"<p>{long}</p>" + "</div>" * 60_000
    assert html_text.text_of(deep, None) == long
    assert html_text.text_of(f"<b><i>{long}" * 3000, None) == long * 3000
    two = f"<body><div class=first><h1>Title</h1><p>{long}</p></div><div class=second><p>{long}</p></div></body>"
    assert html_text.text_of(two, None) == f"{want}\n\n{long}"
    beside = f"<body>{article}<div class=part><p>{long}</p></div></body>"
    assert html_text.text_of(beside, None) == f"{want}\n\n{long}"


def test_html_votes_decide(spark):
    """Pages without article or main: most pages of a host show its path, which then also holds for a page where another container is
    larger; the votes are those of a count over single pages."""
    from collections import Counter

    def page(text, extra):
        return f"<html><body><div class='top'>site</div><div class='box-{len(text)}'><p>{text}</p></div><div class='about'><p>{extra}</p></div></body></html>"

    made = [(k, "https://a.example/x", page("word " * (140 + k), "about " * 2)) for k in range(8)] + [
        (8, "https://a.example/y", page("word " * 30, "about " * 20)), (9, "https://b.example/y", page("word " * 30, "about " * 20))
    ]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    # by hand: a container with 95 % of a page's text gets its vote, which the first eight have in their box; the two others have none
    votes = {"a.example": Counter({">html>body>div.box-N": 8, ">html>body": 1}), "b.example": Counter({">html>body": 1})}
    want = {h: (c.most_common(1)[0]) for h, c in votes.items()}
    assert {r.host: (r.path, r.votes) for r in html_text.host_paths(pages).collect()} == want
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert got[8] == ("word " * 30).strip() and got[0] == ("word " * 140).strip()
    assert "about" in got[9] and "word" in got[9]


@pytest.mark.parametrize("unit", ["<a ", "</p ", '<a ="x', '<a =">"', "</script ", "<!x ", "<a ='>", '="x', "<"])
def test_html_of_a_garbled_page_takes_linear_time(unit):
    import time

    began = time.process_time()
    for before in ("<html><body><p>hello</p>", "<html><script>"):
        html_text.parse(before + unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 3


def test_html_stray_quotes():
    assert html_text.text_of('<p>one</p><p class="a>two</p><p>three</p>', None) == "one\n\ntwo\n\nthree"
    assert html_text.text_of('<p>one</p><a ="b<p>two</p><p title="x>y">three</p>', None) == 'one\n\ny">three'
    assert html_text.text_of("<p>one <!-- two <p>three</p>", None) == "one" and html_text.text_of("<p>a < b</p><p>c <", None) == "a < b\n\nc <"
    assert html_text.text_of("<p>one</p><script>x</script >two</p>", None) == "one\n\ntwo"


def test_html_pages_of_the_tables(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
