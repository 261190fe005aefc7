"""op3, op5, op6 and op8: round trips and the libraries' own results."""

import base64
import hashlib
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import byte_bpe, flac, html_text, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "\n\n  \n", "Hello  world\n\n x", "naïve 日本語 🦊‍", "a" * 3000, "<|endoftext|> x", " lead", "trail ", "tab\t\tx \r\n y", "word " * 30_000, "1234567 12,5", "it's we'll"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 - i, t, "x", 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, start int").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_op3_equals_the_library(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got, own, at = by_id(token_files.write_and_read(docs, path)), Tokenizer.from_file(path), 0
    for i, t in reversed(list(enumerate(TEXTS))):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        r = got[100 - i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.write_and_read(docs.limit(0), path).collect() == []


def test_op3_blocks():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 65536, 700), np.zeros(700, int), np.arange(700), rng.choice([5, 5, 5, 9, 70], 700), np.full(700, 65535), np.tile([1, 2, 3, 4000, 50000], 140)]
    ids = np.stack(rows)
    coded = token_files.encode_blocks(ids)
    assert (token_files.decode_blocks(coded, 700) == ids).all()
    assert len(coded[1]) < 100 and len(coded[5]) < 300
    alone = token_files.decode_blocks(coded[3:4], 700)  # blocks are reset: each decodes without the others
    assert (alone == ids[3:4]).all()


def test_op3_damage():
    segment = token_files.pack([4, None], [np.arange(900, dtype="<u2").tobytes(), b"\1\0"])
    ids, count, _ = token_files.unpack(segment)
    assert ids == [4, None] and count.tolist() == [900, 1]
    for at in (40, len(segment) - 3):
        bad = bytearray(segment)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            token_files.unpack(bytes(bad))


def test_op5_equals_tiktoken(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.digests(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN))
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        r = got[100 - i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op5_gives_its_memory_back_when_a_task_ends(spark):
    """A worker lives on beside other work; without this it kept up to two times 128 MB of pieces as long as it lived."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(500))) for i in range(40)], "doc_id bigint, text string").repartition(8)

    def kept(batches):
        for b in batches:
            held = [len(c.encode.kept) + len(c.encode.kept.old) for c in byte_bpe._codecs.values()]
            yield pa.RecordBatch.from_pydict({"held": pa.array(held, pa.int64())})

    for encode in (byte_bpe.encode, byte_bpe.encode_decode):
        assert encode(docs, path, pattern).filter("ids is not null").count() == 40
        held = [r.held for r in spark.range(0, 64, 1, 8).mapInArrow(kept, "held bigint").collect()]
        assert held and set(held) == {0}


def test_op6(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='<p>no</p>';</script></head><body><nav><a href='/x'>Menu</a></nav>"
        "<!-- <p>no</p> --><div class='ad'>Buy &amp; go</div><article><h1>Main&nbsp;head</h1><p>One <b>two</b>\n\t three&lt;</p><aside>side</aside>"
        "<p>4 &#233;<div id='cookie-notice'>ok?</div><p>end</article><section class=comments><p>first!</p></section><form><p>mail</p></form><footer>foot</footer></body></html>"
    )
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "plain &amp; text", "x"), (5, "u", "<p>" + "word " * 50_000 + "</p>", "x")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()}
    assert got[1].text == "Main head One two three< 4 é end"
    assert [got[i].text for i in (2, 3)] == ["", ""] and got[4].text == "plain & text" and got[5].n_chars == 249_999
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_op8_round_trip(docs):
    got = by_id(flac.digests(flac.with_media(docs)))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[100 - i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[100].media_sha256 == got[99].media_sha256
    blocks = flac.pcm_blocks(flac.with_media(docs)).filter("doc_id = 94").orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks)[:3000] == b"a" * 3000 and blocks[-1].sample_offset % 576 == 0


def test_op8_signals_and_damage():
    rng = np.random.default_rng(4)
    t = np.arange(576 * 5)
    waves = [rng.integers(0, 256, 576 * 3, dtype=np.uint8), np.zeros(576, np.uint8), (128 + 100 * np.sin(t / 9)).astype(np.uint8), np.where(t % 600 < 300, 0, 255).astype(np.uint8)]
    payloads = [w.tobytes() for w in waves]
    media = flac.encode(payloads)
    assert flac.decode(media) == payloads and len(media[2]) < 0.6 * len(payloads[2])
    assert flac.decode(media[2:3]) == payloads[2:3]
    bad = bytearray(media[0])
    bad[-40] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(bad)])
    with pytest.raises(ValueError):
        flac.encode([b"abc"])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div><p>A one</p><div class='ad'>Buy</div><p>B two, which is longer</p></div>", "A one B two, which is longer"),
        ("<h1>Title</h1><div><p>First</p></div><div><p>Second</p><figure><img src=x><figcaption>Caption</figcaption></figure></div>", "Title First Second Caption"),
        ("<p>Text</p><table><tbody><tr><td>1</td><td>2</td></tr></tbody></table><nav><a>x</a></nav><form><p>mail</form><aside>s</aside><p>End</p>", "Text 1 2 End"),
        ("<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul><p>Text <a href=d>link</a></p><p><a href=e>More</a></p>", "Text link More"),
    ],
)
def test_op6_pages_without_article(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p class="ad">Buy<p>one</p><p>two</p>', "one two"),
        ('<ul><li class="ad">Buy<li>one</ul><p>two', "one two"),
        ('<table><tr><td class="ad">Buy<td>one<tr class="promo"><td>x<tr><td>two</table>', "one two"),
        ('<dl><dt class="ad">Buy<dd>one</dl><select><option>x</select>two', "one two"),
        ('<div><form><p>mail</p></div><p>one</p>', "mail one"),
        ('<div><div class="notice">ok <b>x</b></div><p>one</p></div><p>two', "one two"),
        ('<p>one <label>mail</p><p>two</p>', "one two"),
        ('one <svg viewBox="0 0 1 1"/> two <svg><text>x</text></svg>', "one two"),
        ('<div class="notice">ok<p>one</p><nav>menu</nav><p>two</p>', "one two"),
        ('<div class="ad"><ul><li>x<li>y</ul><div>z</div></div>one two', "one two"),
    ],
)
def test_op6_missing_end_tags(page, want):
    assert html_text.main_text(f"<html><body><article>{page}</article><footer>f</footer></body></html>") == want


def test_op3_wide_ids_and_plain_blocks():
    """Ids of 32 bits are coded in halves; random ids, which coding can't shorten, are stored as they are."""
    rng = np.random.default_rng(2)
    for kind, top in (("<u2", 1 << 16), ("<u4", 1 << 32)):
        ids = [rng.integers(0, top, 5000).astype(kind).tobytes(), b"", np.tile([1, 70, 9], 4000).astype(kind).tobytes()]
        segment = token_files.pack([3, 4, 5], ids, kind)
        _, count, found = token_files.unpack(segment)
        assert count.tolist() == [5000, 0, 12000] and found.astype(kind).tobytes() == b"".join(ids)
        assert len(segment) < 5120 * np.dtype(kind).itemsize + 2500


def test_op3_table_of_frequencies():
    """Ids that no context foretells cost what their frequencies say; a segment too small for a table does without."""
    rng = np.random.default_rng(3)
    seldom = rng.choice(1 << 16, 300, replace=False)
    for kind, shift in (("<u2", 0), ("<u4", 16)):
        ids = [(rng.choice(seldom, n).astype(np.uint32) << shift).astype(kind).tobytes() for n in (150_000, 0, 50_001)]
        segment = token_files.pack([1, 2, 3], ids, kind)
        _, count, found = token_files.unpack(segment)
        assert count.tolist() == [150_000, 0, 50_001] and found.astype(kind).tobytes() == b"".join(ids)
        assert len(segment) < 1.25 * 200_001  # log2(300) bits an id are 1.03 bytes
    for ids in (np.arange(1 << 16), np.zeros(200_000, int), np.full(200_000, 65535), np.repeat(np.arange(1 << 16), 20)):
        table = token_files._Frequencies.table(ids)
        frequencies = token_files._Frequencies(table)
        assert frequencies.size.sum() == 1 << 16 and len(frequencies.id) == 1 << 16 and frequencies.size[ids].all()
    assert token_files._Frequencies.table(seldom) == b"" == token_files._Frequencies.table(np.zeros(0, int))


def test_op3_repeated_and_missing_ids(spark):
    rows = [(5, "b b"), (5, "a"), (None, "first"), (5, "a"), (9, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, start int, data string")
    got = token_files.write_and_read(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 5, 5, 5, 9] and got[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))
    assert sorted(r.ids_crc32 for r in got[1:4])[0] in {got[k].ids_crc32 for k in (1, 2, 3)} and len({r.ids_crc32 for r in got[1:4]}) == 2


def test_pieces_equal_whole_texts():
    """Texts encoded by kept pieces have the library's ids, whatever white space they hold, and after pieces were forgotten."""
    from tokenizers import Tokenizer

    from pagemill.llm import chunks

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, (encode, _) = Tokenizer.from_file(path), token_files.library_encoder(path)
    odd = ["a\n\nb  c \n d", "　a b", "x\0 y\0\nz", "a.\n\n\n b", "a ,b. c!? (x), 'll I'll,", "a  b​ c", "\x1c a\x85 b", "hi <|endoftext|> there", "ſtraße, ĦÆ É. x1, 12; 3.", "é ́x, "]
    for text in [t or "" for t in TEXTS] + odd:
        assert np.frombuffer(encode(text), "<u2").tolist() == own.encode(text, add_special_tokens=False).ids
    bound, chunks.KEPT_BYTES = chunks.KEPT_BYTES, 2000
    try:
        text = " ".join(f"w{k % 37} v{k}" for k in range(500))
        assert np.frombuffer(encode(text), "<u2").tolist() == own.encode(text, add_special_tokens=False).ids
    finally:
        chunks.KEPT_BYTES = bound


def test_op3_op5_columns_of_pieces():
    """Texts taken in groups have the ids of texts taken alone: nulls, empty texts, slices, marks after letters, line breaks."""
    import pyarrow as pa
    import tiktoken
    from tokenizers import Tokenizer

    from pagemill.llm import chunks

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own, (encoder, _) = Tokenizer.from_file(path), token_files.library_encoder(path)
    codec = byte_bpe.codec(ranks, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = [None, "", "Élan. ×. ÷, ß! größer: naïve$$$ x_y (a)b x#1", "a\nWord\n\nÉté\n b\n", "a  b\tc", "", None, " x", "\ny", "it's, don't. l'été?", "hi <|endoftext|> there", "中文, 。. x"]
    bound = chunks.SLICE
    try:
        for chunks.SLICE in (1, 40, bound):
            column = pa.array(["before, ", *texts, "after"]).slice(1, len(texts))
            for text, a, b in zip(texts, encoder.column(column), codec.encode.column(column), strict=True):
                assert np.frombuffer(a, "<u2").tolist() == own.encode(text or "", add_special_tokens=False).ids
                assert np.frombuffer(b, "<u4").tolist() == other.encode_ordinary(text or "")
    finally:
        chunks.SLICE = bound
    assert list(encoder.column(pa.array([], pa.string()))) == []


def plain_runs(lengths, window, least):
    """The lines over which no window is empty."""
    gone = {i + k for i in range(len(lengths) - window + 1) if sum(lengths[i : i + window]) <= least for k in range(window)}
    return [i for i in range(len(lengths)) if i not in gone]


def test_op6_windows_equal_a_plain_version():
    rng = np.random.default_rng(6)
    for _ in range(400):
        lengths = (rng.integers(0, 60, rng.integers(0, 30)) * (rng.random() < rng.random(1))).tolist()
        lengths = [n if rng.random() < 0.5 else 0 for n in lengths]
        for window, least in ((1, 0), (3, 0), (3, 25), (7, 10)):
            assert [i for a, b in html_text.surges(lengths, window, least) for i in range(a, b)] == plain_runs(lengths, window, least)


def test_op6_windows_decide():
    """Inside an article and outside one, the window's length decides which lists of links go, the threshold which short lines."""
    links = "".join(f"<li><a href=x>link {k}</a>" for k in range(4))
    body = f"<p>First paragraph</p><ul>{links}</ul><p>Second paragraph</p><p><a href=y>Read on</a></p><p>Third</p>"
    every = "First paragraph link 0 link 1 link 2 link 3 Second paragraph Read on Third"
    for page in (f"<article>{body}</article>", f"<div>{body}</div>"):
        assert html_text.main_text(page) == "First paragraph Second paragraph Read on Third"
        assert html_text.main_text(page, window=1) == "First paragraph Second paragraph Third"
        assert html_text.main_text(page, window=5) == every
        assert html_text.main_text(page, least=5) == "First paragraph Second paragraph Read on Third"
        assert html_text.main_text(page, window=1, least=5) == "First paragraph Second paragraph"
    assert html_text.main_text("<header>Site name and slogan</header><p>Main text</p>") == "Main text"
    assert html_text.main_text("<p><a href=x>only a link</a></p>") == "only a link"


def test_op6_odd_tables(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", "<p>a</p><p>a</p>", "x", "y")] * 3 + [(None, None, "<p>b", None, None), (2, "v", None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, schema))
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()), key=str) == sorted([(1, "u", "a a", 3)] * 3 + [(None, None, "b", 1), (2, "v", "", 0)], key=str)
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


def plain_flac(stream):
    """The samples of a stream, bit by bit."""
    at, last = 4, False
    while not last:
        last, at = stream[at] > 127, at + 4 + int.from_bytes(stream[at + 1 : at + 4], "big")
    bits = "".join(f"{b:08b}" for b in stream[at:])
    pos, out = 0, []

    def take(n):
        nonlocal pos
        pos += n
        return int(bits[pos - n : pos], 2) if n else 0

    def signed(n):
        v = take(n)
        return v - (1 << n) if v >> (n - 1) else v

    def rice(k):
        nonlocal pos
        zeros = bits.index("1", pos) - pos
        pos += zeros + 1
        v = zeros << k | take(k)
        return (v >> 1) ^ -(v & 1)

    while pos < len(bits):
        assert take(16) == 0xFFF8 and take(16) == 0x2002
        lead = take(8)
        take(8 * (0 if lead < 128 else f"{lead:08b}".index("0") - 1) + 8)
        kind, x = take(8) >> 1, []
        if kind == 0:
            x = [signed(8)] * 576
        elif kind == 1:
            x = [signed(8) for _ in range(576)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [signed(8) for _ in range(order)]
            c, shift = [(), (1,), (2, -1)][order], 0
            if kind >= 32:
                precision = take(4) + 1
                shift = take(5)
                c = [signed(precision) for _ in range(order)]
            assert take(6) == 0
            k = take(4)
            while len(x) < 576:
                x.append(rice(k) + (sum(a * b for a, b in zip(c, x[::-1], strict=False)) >> shift))
        out += x
        pos = -(-pos // 8) * 8 + 16
    return bytes(v + 128 for v in out)


def test_op8_equals_a_plain_decoder():
    rng = np.random.default_rng(7)
    waves = [rng.integers(0, 256, 576 * 2), np.zeros(576 * 2), 128 + 100 * np.sin(np.arange(576 * 3) / 9), 60 + rng.integers(0, 9, 576 * 2)]
    payloads = [w.astype(np.uint8).tobytes() for w in waves] + [flac.pad("Plain text, éü. ".encode() * 90)]
    assert [plain_flac(m) for m in flac.encode(payloads)] == payloads


def test_op8_long_payload_in_bounded_memory():
    """A text of 50 MB is coded and decoded in under 500 MB, stream and payload included."""
    import subprocess
    import sys

    code = (
        "import resource, sys; from pagemill.llm import flac; import numpy as np\n"
        "p = flac.pad(np.random.default_rng(1).integers(97, 123, 50_000_000, dtype=np.uint8).tobytes()); m = flac.encode([p])\n"
        "assert all(p[at : at + len(b)] == b for _, at, b in flac.decode_blocks(m)); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=Path(__file__).resolve().parents[2])
    assert int(done.stdout.split()[-1]) < 500_000, done.stderr


def test_op8_stored_odd_tables(spark):
    schema = "doc_id bigint, text string, media string, n_bytes int"
    rows = [(1, "a", "x", 1), (1, "a", "x", 1), (None, None, None, None), (3, "ab " * 300_000, "y", 2), (4, "", "", 0)]
    got = flac.digests(flac.stored(flac.with_media(spark.createDataFrame(rows, schema)))).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in got if r.doc_id) == [(1, 1), (1, 1), (3, 900_000), (4, 0)] and len(got) == 5
    for r in got:
        payload = flac.pad({1: b"a", 3: b"ab " * 300_000}.get(r.doc_id, b""))
        x = np.frombuffer(payload, np.uint8).astype(int) - 128
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        changes = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        assert r.feature == f"n={len(x)};mean={x.sum() / len(x):.6f};rms={(x * x).sum() ** 0.5 / len(x) ** 0.5:.6f};peak={abs(x).max()};changes={changes}"
        media = flac.encode([payload])[0]
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert flac.digests(flac.stored(flac.with_media(spark.createDataFrame([], schema)))).collect() == []
