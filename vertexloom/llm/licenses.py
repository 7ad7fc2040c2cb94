"""Operator 9: license scans over a positional rare-token index, with DataFrame functions only.

A template is a run of words with a mandatory key phrase inside. One pass finds where license words
stand in each file; that small table gives their document frequencies and all that follows. The index keeps, for each template, the
positions of its key phrase's `RARE` rarest words. A file's occurrences of indexed words are looked
up, the postings of a template, rarest words first, are intersected by relative position (occurrence minus position in
the template), and a place counts once the postings of all the key phrase's words agree on it. The score
of a place is the share of the template's words that stand where the template has them. All of this is
row by row: no shuffle but that of the frequencies. Postings are intersected by hash and shares counted in
sorted order, so a file's time grows with its words and not with their square.

Base templates are their own key phrase. Rows: one for each row of docs; null, empty and wordless
texts have no places, empty labels and score 0; nothing but text is looked at; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import lower_ascii, materialize

RARE, CODES = 2, 1024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (label, template, key phrase)
NOTICES = [
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]


def _at(words: list[str], phrase: list[str]) -> int:
    return next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)


def templates() -> list[dict]:
    """All templates as words, with the key phrase and its place in them."""
    rows = [(label, phrase, phrase, True) for phrase, label in BASE.items()] + [(*n, False) for n in NOTICES]
    out = []
    for label, text, key, base in rows:
        words, phrase = text.split(), key.split()
        out.append({"label": label, "words": words, "key": phrase, "at": _at(words, phrase), "base": base})
    return out


def _words(text: Column) -> Column:
    """A text's words, with A-Z lower-cased.

    lower() is many times faster than a translation and differs only in letters beyond ASCII, which no
    template holds; the two of them whose lower case has an ASCII letter keep the translation.
    """
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.regexp_extract_all(F.when(odd, lower_ascii(text)).otherwise(F.lower(text)), F.lit(f"({WORD})"))


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _vocabulary() -> list[str]:
    return sorted({w for t in templates() for w in t["words"]})


def license_words(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, spots), written to the shared folder: where license words stand.

    A spot is position * `CODES` + the word's index in the vocabulary; texts are read and cut into words this once.
    """
    vocabulary = _vocabulary()
    words = docs.select("doc_id", _words(F.coalesce("text", F.lit(""))).alias("words"))
    code = lambda w, i: i.cast("long") * CODES + F.array_position(_strings(vocabulary), w) - 1
    spots = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), code(w, i))), lambda x: x.isNotNull())
    return materialize(words.select("doc_id", F.size("words").cast("long").alias("n_words"), spots.alias("spots")), "spots")


def document_frequencies(found: DataFrame) -> dict[str, int]:
    """In how many rows of license_words each license word occurs (as many entries as there are such words)."""
    vocabulary = _vocabulary()
    indexes = F.array_distinct(F.transform("spots", lambda x: x % CODES))
    counts = dict(found.select(F.explode(indexes).alias("word")).groupBy("word").count().collect())
    return {w: counts.get(k, 0) for k, w in enumerate(vocabulary)}


def scan(found: DataFrame, frequencies: dict[str, int]) -> DataFrame:
    """license_words' rows -> (doc_id, n_words, places), places: array of (label, base, start, share)."""
    number = {w: k for k, w in enumerate(_vocabulary())}
    index = []
    for t in templates():
        ranked = sorted(range(len(t["key"])), key=lambda k: (frequencies.get(t["key"][k], 0), k))
        index.append(t | {"rare": ranked[:RARE]})
    rarest = sorted({number[t["key"][t["rare"][0]]] for t in index})

    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")

    def postings(word: str, k: int) -> Column:
        """Where a key phrase may begin, by the places of a word that stands k after it."""
        return F.transform(F.filter("spots", lambda x: x % CODES == number[word]), lambda x: F.shiftright(x, CODES.bit_length() - 1) - k)

    def agreed(found: Column, t: dict, at: list[int]) -> Column:
        for k in at:
            found = F.array_intersect(found, postings(t["key"][k], k))
        return found

    def starts(t: dict) -> Column:
        """Places of the key phrase: the rare words' postings agree on them, then those of all its words."""
        first, *rare = t["rare"]
        rest = [k for k in range(len(t["key"])) if k not in t["rare"]]
        return _let(agreed(postings(t["key"][first], first), t, rare), lambda s: F.when(F.size(s) > 0, agreed(s, t, rest)).otherwise(s))

    def places(t: dict) -> Column:
        def place(start: Column, share: Column) -> Column:
            return F.struct(F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"), start.alias("start"), share.alias("share"))

        def runs(met: Column) -> Column:
            """A place is in met once for the key phrase and once for each further word that stands."""
            firsts = F.filter(F.sequence(F.lit(0), F.size(met) - 1), lambda i: (i == 0) | (F.get(met, i) != F.get(met, i - 1)))
            share = lambda i, j: (j - i - 1 + len(t["key"])).cast("double") / len(t["words"])
            return _let(firsts, lambda f: F.zip_with(f, F.concat(F.slice(f, 2, F.size(f)), F.array(F.size(met))), lambda i, j: place(F.get(met, i), share(i, j))))

        rest = [k for k in range(len(t["words"])) if not t["at"] <= k < t["at"] + len(t["key"])]
        if not rest:
            return F.transform(starts(t), lambda s: place(s, F.lit(1.0)))
        met = lambda s: F.array_sort(F.concat(s, *(F.array_intersect(s, postings(t["words"][k], k - t["at"])) for k in rest)))
        return _let(starts(t), lambda s: F.when(F.size(s) > 0, _let(met(s), runs)).otherwise(none))

    # A file without any template's rarest word is done.
    some = F.exists("spots", lambda x: (x % CODES).isin(rarest))
    return found.select("doc_id", "n_words", F.when(some, F.concat(*map(places, index))).otherwise(none).alias("places"))


def license_report(found: DataFrame) -> DataFrame:
    """The digest of scan's rows."""
    base = F.filter("places", lambda p: p.base)
    rows = found.withColumn("base_places", base)
    names = lambda places: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(F.transform("base_places", lambda p: p.start)).alias("first_word"),
        F.array_max(F.transform("base_places", lambda p: p.start)).alias("last_word"),
        names("base_places").alias("base_labels"),
        names("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p.share)), F.lit(0.0)).alias("score"),
    )


def oracle(words: str) -> str:
    """The report as DuckDB SQL, from template rows; words: an expression for the words of a text."""
    rows = ",\n".join(f"('{t['label']}', {t['words']}, {t['key']}, {t['at']}, {str(t['base']).lower()})" for t in templates())
    return f"""
with t(label, words, key, spot, base) as (values {rows}),
d as materialized (select row_number() over () r, doc_id, {words} w from documents),
p as materialized (
  select r, label, base, s, (select sum(case when s - spot + k >= 0 and w[s - spot + k + 1] = words[k + 1] then 1 else 0 end) from range(len(words)) q(k)) / cast(len(words) as double) share
  from (select r, w, t.*, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(key)] = key)) s from d, t where list_contains(w, key[1]))),
g as (
  select r, count(*) filter (base) n_base, min(s) filter (base) first_word, max(s) filter (base) last_word, string_agg(distinct label, ',' order by label) filter (base) base_labels,
    string_agg(distinct label, ',' order by label) labels, max(share) score
  from p group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0) score
from d left join g using (r)
"""
