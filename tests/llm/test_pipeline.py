import os
import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_jaccard import brute as brute_components
from test_lines_and_repeats import brute_lines
from test_models_and_packing import smith_waterman


def corpus():
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=25))) for k in range(6)]
    rows, labels = [], []
    for i in range(240):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(12, 40))) for _ in range(rng.randint(1, 4))]
        if 40 <= i < 80:
            lines = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(rng.randint(1, 2))]
        if i % 6 == 1:
            lines.append("the same footer line in many documents")
        if i % 12 == 5:
            lines[0] += " gruff blah"
        if i % 20 == 7:
            lines[-1] += " " + items[i % 6][1]
        rows.append([i, "\n".join(lines)])
        labels.append((i, 1, int(i % 12 == 5)))
    for i in range(240, 280):
        lines = [x.split(" ") for x in rows[i - 200][1].split("\n")]
        for words in lines:  # an edit in each line, so that line dedup leaves it
            words[rng.randrange(len(words))] = f"edited{i}"
        rows.append([i, "\n".join(" ".join(words) for words in lines)])
    rows += [[300, None], [301, ""], [302, rows[2][1]]]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], items, labels


def test_stages_match_brute_force(spark, tmp_path):
    docs, items, labels = corpus()
    d = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    now = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"stage{n}")
        stage(spark, now, d).write.parquet(out)
        now = spark.read.parquet(out)
        kept.append(sorted(now.collect(), key=lambda r: r.doc_id))
    texts = [{r.doc_id: r.text for r in k} for k in kept[:4]]
    original = {i: t for i, t, *_ in docs}
    toxic = {i for i, t in original.items() if "gruff" in (t or "")}
    assert set(texts[0]) == set(original) - toxic
    want = {i: t if original[i] is not None else None for i, _, _, t in brute_lines(sorted(texts[0].items()))}
    assert texts[1] == want and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in kept[1])
    first = {i for i, _, c in brute_components(sorted((i, (t or "").replace("\n", " ")) for i, t in texts[1].items()), 5, 80, 100) if i == c}
    assert set(texts[2]) == first and len(first) < len(texts[1])
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    leaked = {i for i, t in texts[2].items() if any(smith_waterman(words(x), words(t)) >= 25 for _, x in items)}
    assert set(texts[3]) == set(texts[2]) - leaked and leaked
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id, r.piece) for r in kept[4]) == [(i, 0) for i in sorted(texts[3])]
    assert sum(r.length for r in kept[4]) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts[3].values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in kept[4])
    assert os.path.isdir(out)
