"""Licences, personal data, languages, tokens, urls and pages against brute force."""

import hashlib
import html
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, html_extract, language_id, license_scan, pii_bootstrap, queries, url_filter
from ledgerloom.llm.common import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "MIT License", "mit licence, MIT\nLICENSE mit-license", "Überschrift 12.5 «été»", "x" * 50_000, "the GNU General Public License " * 400]


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, score string")


def base_license(text):
    words = WORD.findall((text or "").translate(LOWER))
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    found = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def test_license_scan(spark, sf_dir):
    real = [r["text"] for r in queries.read(spark, sf_dir, "documents").collect()]
    texts = ODD + real
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_license(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert any("cc-by-nc-4.0" in r["labels"] for r in found.values())
    assert license_scan.scan_licenses(docs_of(spark, [])).count() == 0


def test_license_chain_skips_a_gap():
    automaton = license_scan.LicenseAutomaton((("x", "one two three four five six seven eight nine ten"),), {})
    text = b"zero one two three four five and then seven eight nine ten"
    got = license_scan.scan_text(automaton, text, 4, 0.8)
    assert got[5] == "x" and got[6] == pytest.approx(0.9) and got[7] == "x:1:12"


def test_license_repeated_notices_have_a_span_each():
    automaton = license_scan.LicenseAutomaton((("x", "one two three four five six seven eight nine ten"),), {})
    whole, parted = "one two three four five six seven eight nine ten", "one two three four five and seven eight nine ten"
    copies = [whole if i % 3 else parted for i in range(500)]
    got = license_scan.scan_text(automaton, " zero ".join(copies).encode(), 4, 0.8)
    assert got[6] == 1.0 and got[7] == ",".join(f"x:{11 * i}:{11 * i + 10}" for i in range(500))
    got = license_scan.scan_text(automaton, b" ".join([b"one two three four", *[parted.encode()] * 2]), 4, 1.0)
    assert got[6] == pytest.approx(0.9) and got[7] == ""


def brute_scan(templates, words, min_match, min_cover, max_gap):
    """Score and labels by all substrings, all places and a quadratic chain."""
    tokens = [words_of(t.encode()) for _, t in templates]
    has = lambda part: any(part == t[i : i + len(part)] for t in tokens for i in range(len(t) - len(part) + 1))
    size = [max(n for n in range(i + 2) if n == 0 or has(words[i - n + 1 : i + 1])) for i in range(len(words))]
    long = [(i, n) for i, n in enumerate(size) if n >= min_match and (i + 1 == len(words) or size[i + 1] != n + 1)]
    score, labels = 0.0, set()
    for (label, _), t in zip(templates, tokens):
        matches = sorted((i - n + 1, i, a + n - 1) for i, n in long for a in range(len(t) - n + 1) if t[a : a + n] == words[i - n + 1 : i + 1])
        clusters = []
        for m in matches:
            if clusters and m[0] - clusters[-1][-1][1] <= max_gap:
                clusters[-1].append(m)
            else:
                clusters.append([m])
        for cluster in clusters:
            best = []
            for k, (a, b, at) in enumerate(cluster):
                n = b - a + 1
                best.append(n + max((best[j] for j in range(k) if cluster[j][1] < a and cluster[j][2] < at - n + 1), default=0))
            share = min(1.0, max(best) / len(t))
            score = max(score, share)
            if share >= min_cover:
                labels.add(label)
    return score, ",".join(sorted(labels))


@pytest.mark.parametrize("seed", range(4))
def test_license_chains_equal_brute_force(seed):
    rng = random.Random(seed)
    templates = tuple((f"t{i}", " ".join(rng.choice("abcd") for _ in range(rng.randrange(6, 14)))) for i in range(4))
    automaton = license_scan.LicenseAutomaton(templates, {})
    for _ in range(60):
        parts = [" ".join(rng.choice("abcdx") for _ in range(rng.randrange(8))) for _ in range(3)]
        pieces = [t.split() for _, t in templates]
        text = " ".join([parts[0], " ".join(rng.choice(pieces)[: rng.randrange(14)]), parts[1], " ".join(rng.choice(pieces)[rng.randrange(6) :]), parts[2]])
        got = license_scan.scan_text(automaton, text.encode(), 2, 0.6, 5)
        assert (got[6], got[5]) == (pytest.approx(brute_scan(templates, words_of(text.encode()), 2, 0.6, 5)[0]), brute_scan(templates, words_of(text.encode()), 2, 0.6, 5)[1]), text


def test_license_texts_are_whole_spans():
    automaton = license_scan.LicenseAutomaton()
    longest = {label: max((t for x, t in license_scan.NOTICES if x == label), key=len) for label in ("mit", "apache-2.0", "gpl", "bsd-2-clause", "isc", "zlib", "unlicense")}
    text = " -- ".join(["some code here", *longest.values(), "more code"])
    got = license_scan.scan_text(automaton, text.encode())
    spans = [s.split(":") for s in got[7].split(",")]
    at = 3
    for label, notice in longest.items():
        size = len(words_of(notice.encode()))
        assert [label, str(at), str(at + size)] in spans
        at += size
    assert got[6] == 1.0 and sum(s[0] == "mit" for s in spans) == 1
    assert license_scan.scan_text(automaton, b"this is not the MIT license")[5:8] == ("mit", 0.5, "")
    assert license_scan.outermost([(0, 9, "x"), (0, 9, "x"), (2, 5, "x"), (2, 5, "y"), (8, 12, "x")]) == [(0, 9, "x"), (2, 5, "y"), (8, 12, "x")]


def test_suffix_automaton_matches_all_substrings():
    rng = np.random.default_rng(3)
    templates = tuple((f"t{i}", " ".join(rng.choice(list("abc"), 8))) for i in range(5))
    automaton = license_scan.LicenseAutomaton(templates, {"a b": "p"})
    words = [w.encode() for w in rng.choice(list("abcd"), 300)]
    places, long = automaton.scan(words, 1)
    assert sorted(i for _, i in places) == [i for i in range(299) if words[i : i + 2] == [b"a", b"b"]]
    tokens = [words_of(t.encode()) for _, t in templates]
    for end, size, state in long:
        for t, at in automaton.ends[state]:
            assert tokens[t][at - size + 1 : at + 1] == words[end - size + 1 : end + 1]


def brute_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 12 <= len(d) <= 19 and pii_bootstrap.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PII_ODD = [
    "a@b.c@d.e f..g@h-i.j.k. x@y @z.w a@b@c.d 1.2.3.4.5.6.7.8.9 1..2.3.4.5 256.1.1.1 01.002.0003.4 000000001.2.3.4",
    "4111 1111-1111 1111 and 4111  1111 1111 1111 é+1 (017) 555-7713, +1 2 +44.20.7946.0958x +++1234567890 +1(((((((((",
    "+" * 3000 + "1" * 3000, "a@" * 2000, "1." * 3000, "é" * 100 + "u@v.w 10.0.0.1", "%@-.-", "a@b..c a@.b a@-", "1.2.3.4@x.y.z",
]


def test_base_spans_equal_the_patterns(spark, sf_dir):
    real = [r["text"] or "" for r in queries.read(spark, sf_dir, "documents").collect()]
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("a1.@+- ()49"), 60)) for _ in range(400)]
    for text in PII_ODD + noise + real:
        assert pii_bootstrap.base_spans(text) == brute_pii(text), text[:100]


def test_personal_data(spark):
    def card(prefix):
        return next(c for c in (prefix + str(d) for d in range(10)) if pii_bootstrap.luhn(c))

    texts = [None, "", *PII_ODD, *[f"ein Konto nummer {card(f'41111111111{i:04d}')} hier" for i in range(12)], "dein nummer 4111111111119990 da", "other 4111111111119998 da"]
    found = {r["doc_id"]: r for r in pii_bootstrap.find_personal_data(docs_of(spark, texts)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        want = brute_pii(text or "")
        named = ",".join(f"{pii_bootstrap.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert found[i]["base_spans"] == named
        assert [found[i][f"n_{k}"] for k in pii_bootstrap.KINDS] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(filter(None, named.split(","))) <= set(found[i]["spans"].split(","))
    last = len(texts) - 2  # fails the check digit, but stands where cards stand
    assert found[last]["base_spans"] == "" and found[last]["spans"] == "card:12:28" and found[last + 1]["spans"] == ""
    assert pii_bootstrap.find_personal_data(docs_of(spark, [])).count() == 0


def test_personal_data_of_other_shapes(spark):
    texts = [f"please call +1 555-{100 + i}-4567 today" for i in range(12)] + [f"please call 555-{200 + i}-4567 at once" for i in range(6)]
    texts += [f"at once dial call 44{i} 20 7946 0958 now" for i in range(2)] + ["code call 123456789012345678901 x", "room 555-123-4567"]
    texts += [f"mixed +1 555-{300 + i}-4567" for i in range(6)] + [f"mixed 1.2.3.{i} or mixed 4111 1111 1111 1111" for i in range(6)] + ["mixed 555-999-4567"]
    got = [r["spans"] for r in sorted(pii_bootstrap.find_personal_data(docs_of(spark, texts)).collect(), key=lambda r: r["doc_id"])]
    assert got[12:18] == ["phone:12:24"] * 6 and all(g.startswith("phone:") for g in got[18:20])
    assert got[20:22] == ["", ""] and got[-1] == ""


def brute_confident(rows, min_support=5, min_score=0.9):
    """``confident_patterns`` on plain lists."""
    kinds = range(len(pii_bootstrap.ALL_KINDS))
    best, confidence = {}, {}
    while True:
        sure, against = {}, {}
        for pattern, instance, kind, fits in rows:
            for k in kinds:
                own = float(kind == k) if kind is not None else confidence.get(instance, [0.0] * len(kinds))[k]
                sure[pattern, k] = sure.get((pattern, k), 0.0) + own
                against[pattern, k] = against.get((pattern, k), 0.0) + float(kind is None and not fits >> k & 1)
        found = {}
        for p in {r[0] for r in rows}:
            whole = sum(sure[p, k] for k in kinds)
            scores = [sure[p, k] / (whole + against[p, k]) if sure[p, k] >= min_support else 0.0 for k in kinds]
            if max(scores) >= min_score:
                found[p] = (scores.index(max(scores)), max(scores))
        known = len(best)
        best = found | best
        if len(best) == known:
            return {p: k for p, (k, _) in best.items()}
        wrong = {}
        for pattern, instance, kind, fits in rows:
            if kind is None and pattern in best:
                k, score = best[pattern]
                if fits >> k & 1:
                    wrong.setdefault(instance, [1.0] * len(kinds))[k] *= 1.000001 - 0.99 * score
        confidence = {i: [1 - w for w in ws] for i, ws in wrong.items()}


@pytest.mark.parametrize("seed", range(3))
def test_pattern_scores_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = set()
    for i in range(400):
        kind = rng.choice([0, 1, 2, 3, 4, None, None, None])
        fits = 1 << kind if kind is not None else rng.choice([1, 2, 12, 4, 8, 16])
        for p in rng.sample(range(12), 3):
            if fits >> p % 5 & 1 or rng.random() < 0.02:
                rows.add((f"p{p}", f"i{i}", kind, fits))
    got = {r["pattern"]: r["kind"] for r in pii_bootstrap.confident_patterns(spark.createDataFrame(sorted(rows, key=repr), "pattern string, instance string, kind int, fits int")).collect()}
    assert got == brute_confident(rows) and got


def test_planted_identifiers_are_discovered(spark):
    """Keys seeded by assignments stand in other words too, and there lead to keys that are assigned
    nowhere; numbers, checksums and words beside them stay alone. Precision and recall are 1."""
    rng = random.Random(4)
    key = lambda n=32: "".join(rng.choice("abcdef") + rng.choice("0123456789") for _ in range(n // 2))
    seeds = [key() for _ in range(8)]
    planted = [f"deploy with {key(24)} at night" for _ in range(10)]
    decoys = [f"checksum {key(40)} of the file" for _ in range(10)] + [f"deploy without {key(24)}" for _ in range(3)] + ["internationalization1234 with responsibilities at night", f"token = {'x' * 30}"]
    texts = [f"API_KEY: '{s}' is set" for s in seeds[:4]] + [f'TOKEN = "{s}"!!' for s in seeds[4:]] + [f"deploy with {s} at once" for s in seeds] + planted + decoys
    got = [r["spans"] for r in sorted(pii_bootstrap.find_personal_data(docs_of(spark, texts)).collect(), key=lambda r: r["doc_id"])]
    assert got[:4] == ["secret:10:42"] * 4 and got[4:8] == ["secret:9:41"] * 4 and got[8:16] == ["secret:12:44"] * 8
    assert got[16:26] == ["secret:12:36"] * 10 and got[26:] == [""] * len(decoys)


def test_the_method_adds_to_the_base_on_the_tables(spark):
    found = queries.op7_pii(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in queries.read(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert sum(r["n_secret"] for r in found) == sum(len(re.findall(r"(?i)token = \"[0-9a-f]{40}", docs[r["doc_id"]] or "")) for r in found) > 0
    assert all(r["n_spans"] == len(list(filter(None, r["spans"].split(",")))) for r in found)


def test_patterns_are_scored_until_they_settle(spark):
    seeds = [("a", f"s{i}", 3, 8) for i in range(6)]
    unseen = [(p, f"{p}{q}{i}", None, 12) for p, q in ("ab", "bc", "cd") for i in range(6)] + [(q, f"{p}{q}{i}", None, 12) for p, q in ("ab", "bc", "cd") for i in range(6)]
    other = [("x", f"s{i}", 3, 8) for i in range(6)] + [("x", f"t{i}", 2, 4) for i in range(6)] + [("y", f"s{i}", 3, 8) for i in range(6)] + [("y", f"u{i}", None, 4) for i in range(6)]
    graph = spark.createDataFrame(seeds + unseen + other, "pattern string, instance string, kind int, fits int")
    assert {(r["pattern"], r["kind"]) for r in pii_bootstrap.confident_patterns(graph).collect()} == {(p, 3) for p in "abcd"}


def test_language_held_out_accuracy(spark):
    docs = queries.read(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert 200 < len(held) < 470
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_texts(spark):
    train = spark.createDataFrame([(i, "the and of this with " * 5, "en") for i in range(9)] + [(i, "les des avec une dans " * 5, "fr") for i in range(9, 18)], "doc_id long, text string, lang string")
    model = language_id.train(train, held_out=5)
    got = {r["doc_id"]: r for r in language_id.identify(docs_of(spark, [None, "", "123 !!", "The AND", "avec une", "日本語"]), model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "en", "fr"] and got[5]["lang_pred"] in ("en", "fr")
    empty = language_id.train(train.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs_of(spark, ["the"]), empty).collect()} == {"und"}
    kept = language_id.keep_identified(docs_of(spark, [None, "1 2", "the of"]), model)
    assert kept.columns == ["doc_id", "text", "lang", "n_words", "score"] and [r["doc_id"] for r in kept.collect()] == [2]


def brute_language(samples, texts, steep=4.0, sharp=8.0, smooth=0.5):
    """The codes, bit classifiers and loss-weighted decoding, on dictionaries and in plain loops."""
    languages = sorted({lang for _, lang in samples})
    count = {lang: Counter() for lang in languages}
    for text, lang in samples:
        count[lang].update(language_id.features(text.encode()).tolist())
    code = language_id.codebook(len(languages)).tolist()
    sums = {lang: sum(c.values()) for lang, c in count.items()}
    freq = lambda lang, f: (count[lang][f] + smooth) / (sums[lang] + smooth * language_id.FEATURES)

    def weight(bit, f):
        sides = [[freq(lang, f) for lang, row in zip(languages, code) if row[bit] == side] for side in (1, -1)]
        return math.log(sum(sides[0]) / len(sides[0])) - math.log(sum(sides[1]) / len(sides[1]))

    bits = range(len(code[0]))
    trust = [[max(1e-6, row[b] * sum(n / sums[lang] * weight(b, f) for f, n in count[lang].items())) for b in bits] for lang, row in zip(languages, code)]
    out = []
    for text in texts:
        found = language_id.features(text.encode()).tolist()
        margins = [sum(weight(b, f) for f in found) / len(found) for b in bits]
        distance = [sum(t * math.log1p(math.exp(-steep * row[b] * margins[b])) for b, t in enumerate(ts)) / sum(ts) for row, ts in zip(code, trust)]
        share = [math.exp(-sharp * (d - min(distance))) for d in distance]
        out.append((languages[distance.index(min(distance))], max(share) / sum(share)))
    return out


def test_language_equals_brute_force(spark):
    rows = queries.read(spark, "/root/testdata/sf0.001", "documents").limit(120).collect()
    docs = spark.createDataFrame([(r["doc_id"], (r["text"] or "")[:600], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    usable = docs.filter(language_id.remainder("doc_id") != 1).collect()
    samples = [(r["text"], r["lang"]) for r in usable if r["text"] and r["lang"]]
    some = [r for r in docs.collect() if len(language_id.features(r["text"].encode()))][:25]
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    for r, (lang, score) in zip(some, brute_language(samples, [r["text"] for r in some])):
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-4)


def test_languages_are_bounded_ties_and_empty(spark):
    docs = spark.createDataFrame([(i, f"text {lang} {i} " * 5, lang) for i, lang in enumerate("aaaabbbccd" * 20)], "doc_id long, text string, lang string")
    assert language_id.train(docs, max_languages=3).languages == ["a", "b", "c"]
    none = docs.limit(0)
    model = language_id.train(none)
    assert model.languages == [] and language_id.identify(none, model).count() == 0 and language_id.keep_identified(none, model).count() == 0
    same = language_id.train(spark.createDataFrame([(i, "one text for all", lang) for i in range(40) for lang in "ab"], "doc_id long, text string, lang string"))
    lang, score, ambiguous = same.predict(b"one text for all")
    assert lang == "a" and score == pytest.approx(0.5) and ambiguous


@pytest.mark.parametrize("classes", [2, 4, 7, 12])
def test_codewords_differ(classes):
    code = language_id.codebook(classes)
    apart = [(code[i] != code[j]).sum() for i in range(classes) for j in range(i)]
    assert min(apart) >= (code.shape[1] + 1) // 2 - (0 if classes <= 7 else code.shape[1] // 4)


def test_bpe_equals_the_library(spark, sf_dir):
    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    real = [r["text"] for r in queries.read(spark, sf_dir, "documents").collect()]
    texts = [*ODD, "a<|endoftext|>b <|endoftext|><|endoftext|> c", "<|endoftext", "x\x1cy \x85 z\xa0w\u2028", "日本語 ⅷ ²½ 12३４ 'LL 'll it's", "a" * 30_000, " \n\n\t  x  ", "\x00\x01", "😀👩‍👩‍👧", *real]
    found = {r["doc_id"]: r for r in bpe.encode_texts(docs_of(spark, texts), path, lexicon_words=500).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(found[i]["ids"]), "<u4").tolist() == ids, repr(text)[:80]
        assert found[i]["n_tokens"] == len(ids) and found[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_texts(docs_of(spark, []), path).count() == 0


def test_merges_of_many_words_equal_merges_of_one():
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path(queries.TOKENIZER))
    rng = random.Random(6)
    words = [bytes(rng.randrange(256) for _ in range(rng.randrange(90))) for _ in range(1500)] + [b"a" * n for n in range(80)] + [b"ab" * n for n in range(40)]
    words += [" ".join(rng.choice(["the", "of", "tion", "ing", "zqx"]) for _ in range(rng.randrange(6))).encode() for _ in range(1500)]
    one = [np.array(vocabulary.merge(w), "<u4").tobytes() for w in words]
    assert vocabulary.merge_all(words) == one and vocabulary.merge_all([]) == []
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.build({w: vocabulary.merge(w) for w in set(words[::3]) if 0 < len(w) <= 64}))
    assert lexicon.get_all(words) == [lexicon.get(w) for w in words]
    assert bpe.Lexicon(bpe.Lexicon.build({})).get_all([b"a", b""]) == [None, None]
    texts = ["", "one two", "<|endoftext|>", "é" * 500] + [" ".join(w.decode("utf-8", "replace") for w in rng.sample(words, 9)) for _ in range(50)]
    whole = bpe.Encoder(vocabulary, lexicon).encode_all(texts)
    tight = bpe.Encoder(vocabulary, lexicon, memo_words=3, chunk_words=5).encode_all(texts)
    assert whole == tight == [bpe.Encoder(vocabulary).encode(t) for t in texts]


def test_narrow_words_equal_the_pattern():
    every = [chr(c) for c in range(0x250)]
    rng = np.random.default_rng(5)
    texts = [" ".join(every), "".join(every), "a".join(every), *["".join(rng.choice([*every[:200], *"'stlvred  \n"], 80)) for _ in range(3000)]]
    for text in texts:
        assert bpe._NARROW(text) == bpe._WIDE(text)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "é", " the", "a"])}
    block = bpe.Lexicon.build(words)
    (tmp_path / "lexicon").write_bytes(block)
    for lexicon in (bpe.Lexicon(block), bpe.Lexicon.mapped(block), bpe.Lexicon.open(str(tmp_path / "lexicon"))):
        assert {w: np.frombuffer(lexicon.get(w), "<u4").tolist() for w in words} == words
        assert [lexicon.get(w) for w in (b"ta", b"", b"tapss", b"x")] == [None] * 4
    rests = {tuple(sorted(x[i:] for x in words if x[:i] == p)) for w in words for i in range(len(w) + 1) for p in [w[:i]]}
    assert bpe.Lexicon(block).states == len(rests)
    assert bpe.Lexicon(bpe.Lexicon.build({})).get(b"a") is None


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_filter(spark, sf_dir):
    odd = [None, "", "x", "http://", "HTTP://A.Example.ORG/es/x?y", "http://example.org/es", "http://example.org/en/1", "s://notexample.org/en/1x", "s://org?x", "s://org/", "s://org:80/", "s://a.com/fr//", "s://com#/de/"]
    urls = odd + [r["url"] for r in queries.read(spark, sf_dir, "pages").collect()]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    for block_bytes in (1 << 20, 8):
        found = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(pages, block_bytes=block_bytes).collect()}
        assert found == {i: brute_url(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_prefixes_and_ties():
    trie = url_filter.UrlTrie([("allow", "h.org", "/a"), ("block", "h.org", "/a"), ("block", "org", "/a/b"), ("allow", "h.org", ""), ("block", "x.h.org", "/abc"), ("allow", "h.org", "/ab/")])
    assert trie.match("h.org", "/abc") == ("allow", "h.org/a")  # the first given of one host and path
    assert trie.match("h.org", "/a/b") == ("allow", "h.org/a") and trie.match("x.h.org", "/abcd") == ("block", "x.h.org/abc")
    assert trie.match("h.org", "/ab/c") == ("allow", "h.org/ab/") and trie.match("h.org", "") == ("allow", "h.org") and trie.match("org", "/x") is None
    rules = [("block", "h.org", f"/p{i}") for i in range(20_000)]
    many = url_filter.UrlTrie(rules)
    assert many.match("h.org", "/p19999x") == ("block", "h.org/p19999") and many.match("h.org", "/q") is None
    node = many.root["hosts"]["org"]["hosts"]["h"]["paths"]["segments"][""]
    assert len(node["lengths"]) == 5  # looked up by length, not one by one


def article_of(page):
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("<p>|</p>|</h1>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_html_extraction(spark):
    pages = queries.read(spark, "/root/testdata/sf0.01", "pages")
    found = {r["page_id"]: r for r in queries.op2_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    for r in pages.collect():
        assert found[r["page_id"]]["text"] == article_of(r["html"])
    assert any(r["n_template"] > 5 for r in found.values())


def test_html_template_text_and_asides(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div class='x menu'>M</div><div><h1>T{i}</h1><p>Own &eacute;{i}\n text<p>Sign up to our list</div><div id=comments><p>c</p></div><form>f</form></body>", 1) for i in range(12)]
    rows += [(20, None, None, 1), (21, "", "", 1), (22, "x://y", "<p>a<b>b</b><div hidden>no</div><!-- c", 1), (23, "x://z", "<article><p>a &amp &lt;i&gt; &#233;</p><aside>no</aside><section><p>b</section></article><p>out", 1), (24, "x://w", "plain < text", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    for i in range(12):
        assert found[i] == f"T{i}\n\nOwn é{i} text"
    assert [found[i] for i in range(20, 25)] == ["", "", "ab", "a & <i> é\n\nb", "plain < text"]
    joined = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages, max_bytes=0).collect()}
    assert joined == found
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_html_template_text_by_support(spark):
    def page(i, more=""):
        return f"<body><div><h1>T{i}</h1><p>Own text of page {i}, longer than what is shared<p>Sign up to our list{more}</div></body>"

    rows = [(i, f"http://large.org/{i}", page(i, "<p>Sign up to our list" if i == 3 else "")) for i in range(20)]
    rows += [(20, "http://large.org/e", None), (21, "http://large.org/e", " "), (22, "http://large.org/cut", "<body><div><h1>T22</h1>"), (23, "http://large.org/odd", "<p>Error")]
    rows += [(30 + i, f"http://small.org/{i}", page(i)) for i in range(3)] + [(40, "http://small.org/", "")]
    rows += [(50 + i, f"http://copies.org/{i}", f"<p>The same long article that was found twice<p>and goes on here<p>{i}") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in [*range(20), 30, 31, 32]:
        assert got[i] == f"T{i % 30}\n\nOwn text of page {i % 30}, longer than what is shared"
    assert [got[i] for i in (20, 21, 22, 23, 40)] == ["", "", "T22", "Error", ""]
    assert [got[50 + i] for i in range(2)] == [f"The same long article that was found twice\n\nand goes on here\n\n{i}" for i in range(2)]


def test_html_hosts_of_any_size_are_treated_alike(spark):
    rows = [(1000 * n + i, f"http://h{n}.org/{i}", f"<body><div><h1>T{i}</h1><p>Own {'words of the page ' * 3}{i}<p>Same block everywhere</div></body>") for n in (2, 3, 9, 10, 11, 100) for i in range(n)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"T{k % 1000}\n\nOwn {'words of the page ' * 3}{k % 1000}" for k, *_ in rows)


def test_html_paths_agree_on_odd_urls(spark):
    urls = ["http://h.org/1", "HTTP://H.ORG?x", "line\nend://h.org", "a://b://c", "://", "h.org/no", None, "x://É.org/", "x://é.org", "x://h.org\n/p", "  x://h.org#f", "x:/h", "x://İ.org"]
    page = "<body><div><h1>T{0}</h1><p>Own text of page {0}, long enough to stay</p><p>Shared words</p></div></body>"
    rows = [(i, u, page.format(i)) for i, u in enumerate(urls * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    both = [{r["page_id"]: tuple(r) for r in html_extract.extract_pages(pages, max_bytes=m).collect()} for m in (32 << 20, 0)]
    assert both[0] == both[1] and all("Shared" not in r[2] for r in both[0].values())
    hosts = pages.select("url", html_extract._host("url").alias("h")).collect()
    assert all(r["h"] == html_extract.host_of(r["url"]) for r in hosts)


def brute_template(pages, support=0.5):
    """The skeleton, with whole occurrence vectors for classes, and the template's texts."""
    vectors, places, texts = {}, {}, {}
    for i, page in enumerate(pages):
        tags, runs, _ = html_extract.tokens_of(page)
        for k, t in enumerate(tags):
            vectors.setdefault(t, Counter())[i] += 1
            places.setdefault(t, {}).setdefault(i, k / len(tags))
        for t, *_ in runs:
            texts.setdefault(t, set()).add(i)
    classes = {}
    for t, v in vectors.items():
        classes.setdefault(tuple(sorted(v.items())), []).append(t)
    valid = {t for v, c in classes.items() if len(c) >= 2 and len(v) >= support * len(pages) and all(n == 1 for _, n in v) for t in c}
    return {t: sum(places[t].values()) / len(places[t]) for t in valid}, {t for t, seen in texts.items() if len(seen) > support * (len(pages) + 1)}


def test_html_classes_equal_brute_force(spark):
    rng = random.Random(5)
    rows, by_host = [], {}
    for host in range(12):
        for i in range(rng.randrange(2, 15)):
            blocks = "".join(rng.choice(["<p>a</p>", "<ul><li>b</ul>", "<div><h2>c</h2></div>", f"<p>own {i}</p>", "<section><p>d</section>"]) for _ in range(6))
            page = f"<body><header><b>H{host}</b></header><main><h1>{i}</h1>{blocks}</main>{'<aside>x</aside>' if rng.random() < 0.7 else ''}</body>"
            rows.append((len(rows), f"http://h{host}.org/{i}", page))
            by_host.setdefault(f"h{host}.org", []).append(page)
    found = html_extract.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["host"]: r["pages"] for r in found} == {h: len(p) for h, p in by_host.items()}
    for r in found:
        skeleton, texts = brute_template(by_host[r["host"]])
        got = [t & (1 << 64) - 1 for t in r["skeleton"]]
        assert set(got) == set(skeleton) and {t & (1 << 64) - 1 for t in r["texts"]} == texts
        assert all(skeleton[a] <= skeleton[b] + 1e-12 for a, b in zip(got, got[1:]))


def test_html_template_alone_finds_the_article(spark, monkeypatch):
    """Without any list of elements or class words, the templates of the hosts choose the text."""
    pages = queries.read(spark, "/root/testdata/sf0.1", "pages")
    parts = [f.name for f in html_extract._TEMPLATE.fields[1:]]
    made = {r["host"]: html_extract._template(*[r[p] for p in parts]) for r in html_extract.templates(pages).collect()}
    rows = pages.select("url", "html").limit(300).collect()
    monkeypatch.setattr(html_extract, "ASIDE", html_extract.HARD)
    monkeypatch.setattr(html_extract, "ASIDE_WORDS", frozenset())
    monkeypatch.setattr(html_extract, "ROOTS", frozenset())
    for url, page in rows:
        assert html_extract.extract(page, made[html_extract.host_of(url)])[0] == article_of(page) != html_extract.extract(page)[0]


def test_html_template_chooses_slots(spark):
    def page(i):
        menu = "".join(f"<a href=/{i + k}>Topic {i + k} of the day</a>" for k in range(3))
        teasers = "".join(f"<div><span>Teaser {(i + k) % 4} that many pages show</span></div>" for k in range(2))
        return f"<body><section>{menu}</section><div class='with sidebar'><h1>T{i}</h1><p>Own {'text of page %d ' % i * 9}</p>{teasers}</div><section><p>Reader {i} says</p></section></body>"

    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\n\nOwn {('text of page %d ' % i * 9).strip()}" for i in range(40)), got[7]


@pytest.mark.parametrize("wrapper", ["class='with-sidebar'", "class='no-ads x'", "id='has-banner'", "class='page-overlay'", "class='sidebar'", "role=complementary"])
def test_html_wrappers_are_no_asides(wrapper):
    inner = "<article><h1>T</h1><p class='notice'>Mind this.<section id='related-work'><p>Others did.</section><div class='social-policy'>Be kind.</div><div class='share'>Tweet</div></article>"
    want = "T\n\nMind this.\n\nOthers did.\n\nBe kind."
    assert html_extract.extract(f"<body><div {wrapper}><nav>Home</nav>{inner}</div><div class='main-nav'>Menu</div></body>")[0] == want
    assert html_extract.extract(f"<body><div {wrapper}><p>A long text that makes up the page</p><div class='comments'>c</div></div><p>out</body>")[0].startswith("A long text that makes up the page")


def test_html_falls_back_to_asides():
    assert html_extract.extract("<body><nav>Only</nav><footer>this</footer><script>no</script><p hidden>no</p></body>")[0] == "Only\n\nthis"
    assert html_extract.extract("<body><nav>Menu</nav><div class='ad'>only this</div></body>")[0] == "only this"
    assert html_extract.extract("<form><article>Text of the page</article><input></form>")[0] == "Text of the page"


def test_html_counts_survive_a_full_task(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", f"<p>own {i}<p>shared") for i in range(30)], "page_id long, url string, html string").coalesce(1)
    rows = [html_extract.occurrence_rows(pages, "page_id", "url", "html", max_runs=n).groupBy("host", "token", "kind").agg(F.sum("pages").alias("p"), F.sum("occurrences").alias("o")).collect() for n in (3, 1 << 17)]
    assert sorted(map(tuple, rows[0])) == sorted(map(tuple, rows[1])) and sum(r["kind"] == 1 for r in rows[0]) == 31


@pytest.mark.parametrize("page", ["<" * 50_000, "<div>" * 20_000 + "</p>" * 20_000, "<a \"" * 20_000, "<!--" * 20_000, "<script>" * 20_000, "&amp;" * 20_000 + "<p"])
def test_html_is_linear_on_broken_pages(page):
    assert isinstance(html_extract.extract(page)[0], str)


def test_digest_columns(spark, sf_dir):
    got = queries.op10_bpe(spark, sf_dir).join(queries.read(spark, sf_dir, "documents"), "doc_id").collect()
    assert all(r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in got)
    assert queries.op7_pii(spark, sf_dir).filter(F.length("base_sha256") != 64).count() == 0
