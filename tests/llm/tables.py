"""Small tables with the cases that operators must stand: nulls, empty and long
texts, ties, repeated rows, and extra columns whose names clash."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

EXTRA = ("size", "shard", "slot", "row", "key", "h", "k", "fp", "mark", "hits", "best_id", "best_mark", "target", "score", "rank")
PASSAGE = "This passage of more than forty characters stands in very many documents Today."


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def documents():
    rng = random.Random(11)
    rows = []
    items = [sentence(rng, 30), sentence(rng, 14), "short item of five words", "one", "", None, "short item of five words"]
    for i in range(60):
        text = "\n".join(sentence(rng, rng.randint(5, 60)) + rng.choice([".", "!", ""]) for _ in range(rng.randint(1, 5)))
        if i % 6 == 0:
            text += f"\n  {PASSAGE.upper() if i % 12 else PASSAGE}\t\nlast line"
        if i % 9 == 0:
            text += " " + items[0].upper().replace(" ", ", ")
        if i % 10 == 3:
            text += " x " + " ".join(items[1].split()[:13]) + " y"
        if i % 20 == 7:
            text = "Short--item OF five words"
        rows.append((i, text, ["s1", "s2", "ß", None, "s1"][i % 5]))
    base = sentence(rng, 400)
    for i in range(60, 75):  # copies and near copies
        words = base.split()
        if i % 3 == 1:
            words[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(words), "copies"))
    same = "\n".join(["equal line of some length here"] * 30) + " tail words"
    rows += [(80, None, "s1"), (81, "", "s2"), (82, " \t\n ", None), (83, "a", "s1"), (84, same, "s9"), (85, "Ünï çødé 漢字 " * 30, "s9"), (86, "x" * 5000, "s9"), (87, sentence(rng, 30000), "big"), (88, "\n".join([PASSAGE] * 3), "s2")]
    rows += [rows[5], rows[5], (5, "other text under a used id", "s1"), (None, PASSAGE, "s1"), (None, None, None)]
    return rows, items


def write(folder, empty=False):
    folder.mkdir(parents=True, exist_ok=True)
    docs, items = ([], []) if empty else documents()
    cols = {"doc_id": pa.array([r[0] for r in docs], pa.int64()), "text": pa.array([r[1] for r in docs], pa.string()), "lang": pa.array(["en"] * len(docs), pa.string()), "source": pa.array([r[2] for r in docs], pa.string()), "n_chars": pa.array([len(r[1] or "") for r in docs], pa.int64())}
    more = {c: pa.array(range(len(docs)), pa.int64()) for c in EXTRA}
    pq.write_table(pa.table(cols | more), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([10 * i for i in range(len(items))], pa.int64()), "text": pa.array(items, pa.string()), "win": pa.array(["w"] * len(items), pa.string())}), folder / "benchmark.parquet")
    labels = [] if empty else [(r[0], int((r[0] or 0) % 4 == 0)) for r in docs if r[0] is not None] + [(None, 1), (3, None), (999, 1)]
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([x[1] for x in labels], pa.int32())}), folder / "labels.parquet")
    turns = [] if empty else [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\x"), (1, 1, "assistant", "again"), (1, 2, None, None), (2, 0, "assistant", None), (None, None, "tool", "Ünï 漢字 <s> <\\s>"), (None, 3, "assistant", "é" * 50 + "\n"), (3, 0, "user", "[/INST]<|endoftext|>[\\\\INST]"), (3, 0, "user", "[/INST]<|endoftext|>[\\\\INST]")]
    turns += [] if empty else [(9, i, "user" if i % 2 else "assistant", f"turn {i} <s> says") for i in range(1500)]
    pq.write_table(pa.table({"conv_id": pa.array([t[0] for t in turns], pa.int64()), "turn": pa.array([t[1] for t in turns], pa.int64()), "role": pa.array([t[2] for t in turns], pa.string()), "text": pa.array([t[3] for t in turns], pa.string()), "task": pa.array([0] * len(turns), pa.int64())}), folder / "conversations.parquet")
    urls = ["https://WWW.Example.ORG/es/x?q#f", "http://example.org", "http://example.org/en/12", "http://badexample.org/es/1", "https://a.fr.com/fr/1", "https://com/de/", "https://x.com/es/#com/de/", None, "no scheme /es/", "ftp://h?x", "https://x.net/a.org/", "x://ads.site.net/a", "https://x.org:80/en/1", "http://u@example.org/es/", "https://example.org/en/1" + "9" * 3000, "a://b://c/d", "https://example.org/es/x"]
    pages = [] if empty else [(i, u, HTML[i % len(HTML)]) for i, u in enumerate(urls)] + [(0, urls[0], HTML[0]), (None, urls[1], HTML[1])]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string()), "host": pa.array([1] * len(pages), pa.int64())}), folder / "pages.parquet")
    return str(folder)


#: Pages, and the main text of each.
HTML = [
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Head &amp; line</h1><p>One\n two&nbsp;three<br>four <b>bold</b>ly <a href='x'>link</a>.<p>Next"
    "<div class=\"ad\">buy buy buy buy buy</div><p>Last.</p></article><footer>&copy; me</footer></body></html>",
    "", None, "plain text only", "<script>var t='</p>'</script><p>a",
    "<body><div id=cookie-banner>We use cookies, accept them all please</div><div class='content'><p>The text of the page stands here.</p><ul><li>first</li><li>second item</li></ul></div><div class=comments><p>I like this page a lot and more</p></div></body>",
    "<main><h2>Title</h2><p>" + "word " * 20000 + "</p><aside>no no no</aside></main><form><label>Your name</label><input></form>", "<nav><a>only menu</a></nav>", "<p>cut off &#233;t&eacute; <a href=\"x",
]
TEXTS = [
    "Head & line\n\nOne two three four boldly link.\n\nNext\n\nLast.", "", "", "plain text only", "a",
    "The text of the page stands here.\n\nfirst\n\nsecond item", "Title\n\n" + " ".join(["word"] * 20000), "", "cut off été",
]
