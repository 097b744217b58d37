"""Every operator against a plain restatement of its contract, on a small table
and on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import decontamination, fertility, license_scan, personal_data, queries, simhash, substring_dedup
from lodestar.llm.license_rules import BASE
from tests.llm.conftest import ALNUM, LOWER, WORD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def multiset(rows):
    return Counter(tuple(r) for r in rows)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["docs", "edge", "empty"])
def table(request):
    return request.getfixturevalue(request.param)


def test_fertility_base(table):
    want = []
    for i, t in texts_of(table):
        words = WORD.findall(t or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = [any(0 <= k < len(words) - 2 and windows[tuple(words[k:k + 3])] > 1 for k in range(n - 2, n + 1))
                  for n in range(len(words))]
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n, repeats = len(words), sum(inside)
        want.append((i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeats,
                     n < 50 or 100 * repeats > 50 * n))
    got = fertility.fertility_rules(table, name="x").select(
        "doc_id", "x.n_words", "x.word_chars", "x.n_symbols", "x.n_dup_lines", "x.n_repeat_words", "x.base_failed")
    assert multiset(got.collect()) == multiset(want)


def test_fertility_measures_follow_the_vocabularies(docs):
    import math
    v = fertility.vocabulary(fertility.VOCABULARIES)
    rows = fertility.fertility_rules(docs, name="x").select("text", "x.*").limit(40).collect()
    for r in rows:
        joined = " ".join(WORD.findall(r["text"]))
        tokens, pieces = v.bpe.encode_ordinary(" " + joined), v.pieces.encode(joined)
        assert (r["n_tokens"], r["n_pieces"]) == (len(tokens), len(pieces))
        assert r["fallback_share"] == pytest.approx(sum(map(v.pieces.is_byte, pieces)) / len(pieces))
        counts = Counter(tokens)
        assert r["token_entropy"] == pytest.approx(-sum(c / len(tokens) * math.log2(c / len(tokens)) for c in counts.values()))
        assert not (r["base_failed"] and r["kept"])


def test_tokens_of_a_word_do_not_depend_on_its_neighbours():
    """Odd words (other white space, marks, rewritten characters) in any mix and any order."""
    import random
    odd = ["\u2003", "a\u2003b", "\ufeff", "x\ufeffy", "\u00ad", "co\u00adop", "\u2581", "x\u2581y", "\x1c", "q\x1cr", "\u0301a", "e\u0301",
           "\ufdfa", "\u00a0", "n\u00a0m", "\u200b", "\u3000", "\uff21\uff22", "\u2126", "\u0133", "\u212a", "\U0001F600", "\u0e33", "\u0149",
           "don't", "It's", "word", "Stra\u00dfe", "\u00e9t\u00e9", "42", "...", "a.b,c", "\u6f22\u5b57", "\u041c\u043e\u0441", "x" * 300, "'s", "\x7f"]
    fresh = lambda: fertility.Vocabulary(fertility.VOCABULARIES)

    def counts(v, words):
        ids = v.ids([w.encode() for w in words])
        return [tuple(v.sizes[1:, i].tolist()) + tuple(v.text_tokens(np.array([i])).tolist()) for i in ids]
    import numpy as np
    v = fresh()
    alone = {}
    for w in odd:
        v.reset()
        alone[w] = counts(v, [w])[0]
        assert alone[w][0] == len(v.bpe.encode_ordinary(" " + w)) and alone[w][1] == len(v.pieces.encode(w))
    rng = random.Random(2)
    for _ in range(300):
        v.reset()
        mix = [rng.choice(odd) for _ in range(rng.randrange(1, 12))]
        cut = rng.randrange(len(mix) + 1)
        assert counts(v, mix[:cut]) + counts(v, mix[cut:]) == [alone[w] for w in mix]


def test_fertility_bands_reject():
    one = fertility.measure()()
    prose = ("Along the northern shore the fishing village keeps its narrow lanes, and every morning small boats leave before "
             "sunrise with nets mended during long winter evenings. Children carry bread to their grandparents, who sit near the "
             "harbour wall telling stories about storms, distant islands, lost anchors and the lighthouse keeper who once painted "
             "each window in a different colour so that sailors would know which door was open.")
    noise = " ".join(f"{chr(0x1F600 + i % 50)}{chr(0x1F680 + i % 61)}{i % 7}" for i in range(80))
    (good, bad) = one([prose, noise])
    assert good[6] and not good[5]
    assert not bad[5] and not bad[6] and bad[12] > 0.5  # byte fallback


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[n:n + k]).encode(), seed=42) for n in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(ids_and_prints, roots=False):
    """Smallest id (or the root) of each fingerprint's component, by comparing all pairs."""
    prints = sorted({p for _, p in ids_and_prints})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for n, a in enumerate(prints):
        for b in prints[n + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    if roots:
        return {p: find(p) for p in prints}
    lowest = {}
    for i, p in ids_and_prints:
        if i is not None:
            lowest[find(p)] = min(i, lowest.get(find(p), i))
    return {p: lowest.get(find(p)) for p in prints}


@pytest.mark.parametrize("hot", [256, 1])
def test_simhash(table, hot):
    prints = [(i, fingerprint(t)) for i, t in texts_of(table)]
    groups = grouped(prints)
    got = simhash.near_duplicates(table, hot=hot).select("doc_id", "fingerprint", "component_id").collect()
    assert multiset(got) == multiset((i, f"{p:016x}", groups[p]) for i, p in prints)


def test_simhash_crowded_segments(spark):
    """Dense fingerprints: every pair of the brute force, deep search or not."""
    import random
    rng = random.Random(5)
    bases = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)) for b in bases for _ in range(120)}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    for hot in (1, 7, 256):
        got = {tuple(sorted(r)) for r in simhash.fingerprint_links(fps, hot=hot).collect()}
        assert got == want


def test_simhash_keeps_one_of_each_group(edge):
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns
    prints = [(i, fingerprint(t)) for i, t in texts_of(edge)]
    lowest, roots = grouped(prints), grouped(prints, roots=True)
    got = [(r["doc_id"], roots[fingerprint(r["text"])]) for r in kept.collect()]
    assert Counter(got) == Counter({(lowest[p], root): 1 for p, root in roots.items()})
    assert simhash.keep_first(edge.filter("false")).count() == 0


def base_spans(t):
    def luhn(d):
        return sum(int(c) * (1 + k % 2) - 9 * (int(c) * (1 + k % 2) > 9) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


TRICKY = ["a@b.c d@e@f.g x@y", "@a.b a.@b.c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256.1.1.1", "+1 22-33 (44) 555666 777.8889999 +1",
          "4111-1111-1111-1111 4111111111111112 00000000000000", "a%b+c-d@x-y.z-", "..@..", "+12 345 678 90 12 345 6789", "é@é.é a@b.é",
          "0" * 5_000 + ".1.1.1", "1.1." + "0" * 4_500 + "255.0", "1.1.1." + "7" * 5_000, "4" * 7_000, "+" + "2" * 6_000, "1-" * 5_000 + "1"]


def test_personal_data_base_patterns():
    for text in TRICKY:
        assert personal_data.base_spans(text) == base_spans(text), text


def test_personal_data(table):
    got = personal_data.personal_data(table, name="x").select("text", "x.spans").collect()
    assert len(got) == table.count()
    for r in got:
        text = r["text"] or ""
        spans = [(s["start"], personal_data.KINDS.index(s["kind"]), s["stop"]) for s in r["spans"]]
        own = [s for s, x in zip(spans, r["spans"]) if x["base"]]
        assert own == base_spans(text)
        assert spans == sorted(spans)
        for start, kind, end in set(spans) - set(own):
            assert personal_data.valid(personal_data.KINDS[kind], text[start:end])
            assert not any(a < end and start < b for a, _, b in own)


def test_skip_chain_carries_a_label_to_a_distant_token():
    """A token that is a secret in one place is one where no cue stands."""
    import numpy as np
    token = "9fd8a7c6b5e4f3a2d1c0b9a8"
    text = f'token = "{token}" and much later, {"word " * 40} again {token} stands alone; 2019'
    t = personal_data.tokens_of(text)
    assert len(t.skip) == 1
    secret = personal_data.LABELS.index("secret")
    unary = np.zeros((personal_data.FEATURES, personal_data.N_LABELS))
    field = personal_data.Field(unary, np.zeros((6, 6)), np.eye(6) * 3)
    first = t.features[0]
    only = [f for f in first if f not in t.features[1]]
    unary[only[0], secret] = 9
    p = field.marginals(t)
    assert p[1, secret] > 0.8 and p[2, secret] < 0.5
    field.skip[:] = 0
    assert field.marginals(t)[1, secret] < 0.5


def test_skip_chain_reaches_every_occurrence():
    """A cue's label reaches each later occurrence alike, however many there are."""
    import numpy as np
    token = "abcdef123456ghijkl7"
    for n in (3, 40, 400):
        t = personal_data.tokens_of(f"the password = {token} " + " ".join(f"filler words here {token}" for _ in range(n)))
        assert len(t.skip) == n
        secret = personal_data.LABELS.index("secret")
        unary = np.zeros((personal_data.FEATURES, personal_data.N_LABELS))
        cue = set(t.features[0]) - set(t.features[1])
        for f in cue:
            unary[f, secret] = 4.0
        p = personal_data.Field(unary, np.zeros((6, 6)), np.eye(6) * 3).marginals(t)
        assert p[1:, secret].min() > 0.5 and np.ptp(p[1:, secret]) < 1e-3


def test_belief_propagation_is_exact_on_a_tree_of_skips():
    import itertools

    import numpy as np
    rng = np.random.default_rng(9)
    n, L = 5, personal_data.N_LABELS
    field = personal_data.Field(rng.normal(size=(personal_data.FEATURES, L)), rng.normal(size=(L, L)), None)
    s = rng.normal(size=(L, L))
    field.skip = (s + s.T) / 2
    lone = (np.zeros(n, bool),) * 2
    pairs = [(0, 1)], [(0, 2), (0, 3), (1, 4)]
    t = personal_data.Tokens([(0, 1)] * n, np.arange(n)[:, None], *[np.array(p) for p in pairs], *lone)
    want = np.zeros((n, L))
    for y in itertools.product(range(L), repeat=n):
        w = np.exp(sum(field.unary[i, y[i]] for i in range(n)) + field.chain[y[0], y[1]] + sum(field.skip[y[a], y[b]] for a, b in pairs[1]))
        for i in range(n):
            want[i, y[i]] += w
    assert np.abs(field.marginals(t) - want / want.sum(axis=1, keepdims=True)).max() < 1e-3


def test_a_long_row_of_neighbours_settles():
    """What the first of 300 neighbours says arrives at the last where potentials carry it."""
    import numpy as np
    n, L = 300, personal_data.N_LABELS
    unary = np.zeros((personal_data.FEATURES, L))
    unary[1, 5] = 20.0
    features = np.zeros((n, 1), int)
    features[0] = 1
    chain = np.stack([np.arange(n - 1), np.arange(1, n)], 1)
    t = personal_data.Tokens([(0, 1)] * n, features, chain, np.empty((0, 2), int), *(np.zeros(n, bool),) * 2)
    p = personal_data.Field(unary, np.where(np.eye(L, dtype=bool), 12.0, 0.0), np.zeros((L, L))).marginals(t)
    assert p[-1, 5] > 0.9


def test_planted_secrets_far_from_their_cue(spark):
    """A trained field marks the later places of a cued secret, and nothing in clean texts."""
    import random
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"

    def secret():
        return "k7" + "".join(rng.choice(letters) for _ in range(20)) + "3x"
    rows, planted = [], {}
    for i in range(120):
        word = " ".join(rng.choice(["river", "lamp", "stone", "house 12", "room 7b", "in 1999"]) for _ in range(30))
        key = secret()
        rows.append((i, f"{word} password: {key} {word}\n" + f"and later {key} again {word}\n" * (3 if i else 30)))
        planted[i] = key
    rows += [(1000 + i, " ".join(f"house {k} on street {k % 9}" for k in range(i, i + 40))) for i in range(60)]
    got = personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), name="x").collect()
    for r in got:
        found = [r["text"][s["start"]:s["stop"]] for s in r["x"]["spans"]]
        if r["doc_id"] in planted:
            assert found == [planted[r["doc_id"]]] * (4 if r["doc_id"] else 31)
        else:
            assert not found


def test_belief_propagation_is_exact_on_a_chain():
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    n, L = 4, personal_data.N_LABELS
    unary = rng.normal(size=(personal_data.FEATURES, L))
    field = personal_data.Field(unary, rng.normal(size=(L, L)), np.zeros((L, L)))
    lone = np.array([True, False, False, False]), np.array([False, False, False, True])
    t = personal_data.Tokens([(0, 1)] * n, np.arange(n)[:, None], np.array([[0, 1], [1, 2], [2, 3]]), np.empty((0, 2), int), *lone)
    want = np.zeros((n, L))
    u = unary[:n].copy()
    u[0] += field.chain[0]
    u[3] += field.chain[:, 0]
    for y in itertools.product(range(L), repeat=n):
        w = np.exp(sum(u[i, y[i]] for i in range(n)) + sum(field.chain[y[i], y[i + 1]] for i in range(n - 1)))
        for i in range(n):
            want[i, y[i]] += w
    want /= want.sum(axis=1, keepdims=True)
    assert np.abs(field.marginals(t, rounds=60) - want).max() < 1e-2


def contamination(texts, items, window=13):
    wanted = []
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        size = min(window, len(w))
        wanted += [(tuple(w[k:k + size]), item) for k in range(len(w) - size + 1) if w]
    sizes = {len(w) for w, _ in wanted}
    owners = {}
    for w, item in wanted:
        owners.setdefault(w, set()).add(item)
    out = []
    for i, t in texts:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                items_here = owners.get(tuple(w[k:k + size]))
                if items_here:
                    hit.update(range(k, k + size))
                    found |= items_here
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(found), sha(",".join(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def contract4(df):
    return df.select("doc_id", "h_.n_words", decontamination.covered_words("h_.spans").alias("n_hit"),
                     F.size("h_.items").cast("long").alias("n_items"),
                     queries.hex_sha256(F.concat_ws(",", "h_.items")).alias("items_sha256"), decontamination.contaminated("h_"))


@pytest.mark.parametrize("block_chars", [1_000_000, 2_000])
def test_decontamination(table, benchmark, spark, block_chars):
    more = spark.createDataFrame(
        [(900, "shared3 shared4 shared5"), (901, "one"), (902, None), (903, ""), (None, "shared20 shared21"), (901, "shared7"),
         (904, " ".join(f"shared{i}" for i in range(5, 25)))], "item_id long, text string")
    items = benchmark.select("item_id", "text").unionByName(more)
    got = contract4(decontamination.contamination(table, items, name="h_", block_chars=block_chars))
    want = contamination(texts_of(table), [(r["item_id"], r["text"]) for r in items.collect()])
    assert multiset(got.collect()) == multiset(want)


def test_decontamination_without_items(edge, benchmark):
    got = contract4(decontamination.contamination(edge, benchmark.filter("false"), name="h_")).collect()
    assert multiset(got) == multiset(contamination(texts_of(edge), []))


def repeated(texts, window=35):
    words = [WORD.findall(t or "") for _, t in texts]
    seen = Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(texts, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


@pytest.mark.parametrize("hot,shard_words", [(5000, 1_000_000), (0, 400), (5000, 300)])
def test_substring_dedup(table, hot, shard_words):
    got = substring_dedup.drop_repeated(table, hot=hot, shard_words=shard_words).collect()
    assert multiset(got) == multiset(repeated(texts_of(table)))


def test_license_base(table):
    want = []
    for i, t in texts_of(table):
        w = ALNUM.findall((t or "").translate(LOWER))
        places = [(k, label) for phrase, label in BASE.items() for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
        want.append((i, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
                     ",".join(sorted({x for _, x in places}))))
    got = license_scan.scan(table)
    assert multiset(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == multiset(want)
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_license_rules_agree_with_python(docs, spark):
    from lodestar.llm.license_rules import rules
    signatures = rules()
    assert len(signatures) >= 300 and len({r.rule_id for r in signatures}) == len(signatures)
    texts = [
        "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0. See the LICENSE file for details",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "Released under CC BY-NC-SA 4.0 and also CC BY 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License",
        "mit license mit license MIT No Attribution License", "dual: MIT license, gpl v2, LGPL 2.1", "nothing here", "all rights reserved",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ]
    for text in texts:
        words = " " + " ".join(ALNUM.findall(text.translate(LOWER))) + " "
        found = []
        for n, r in enumerate(signatures):
            if r.keyword in words:
                for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", words):
                    first = words[:m.start()].count(" ") - 1
                    found.append((first, first + m.group().count(" "), n, r))
        stays = [d for d in found if not any(
            e is not d and e[0] <= d[0] and e[1] >= d[1] and ((e[0], e[1]) != (d[0], d[1]) or e[2] < d[2]) for e in found)]
        base = {label for phrase, label in BASE.items() if f" {phrase} " in words}
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        r = license_scan.scan(df).first()
        assert r["labels"] == ",".join(sorted({d[3].label for d in stays} | base)), text
        assert r["score"] == max([d[3].score for d in stays] + [license_scan.BASE_SCORE] * bool(base), default=0.0), text


def test_license_gate_covers_every_rule():
    from lodestar.llm.license_rules import LICENSE_WORDS, rules
    gates = set(license_scan.gate_words(rules()))
    for r in rules():
        assert set(r.keyword.split()) & gates or "licen" in r.keyword.split() and set(LICENSE_WORDS) <= gates


def test_licence_gate_is_no_stricter_than_the_rules(spark):
    from lodestar.llm.license_rules import rules
    texts = [f"released under {x}" for x in ("GPL3", "LGPL3", "AGPL3", "gpl2")] + ["nothing here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), license_scan.joined_words(F.col("text")).alias("words"))
    passed = {r["id"] for r in words.filter(license_scan.gated(F.col("words"), rules())).select("id").collect()}
    assert passed == {0, 1, 2, 3}
    gpl = [r for r in rules() if r.keyword in ("gpl", "lgpl", "agpl")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs, signatures=gpl).collect()}
    assert got == {0: "gpl", 1: "lgpl", 2: "agpl", 3: "gpl", 4: "", 5: ""}
    for keyword in {r.keyword for r in rules()}:  # also inside longer words
        assert any(w in f"x{keyword}x" for w in license_scan.gate_words(rules()))
