"""Licences by sentence rules.

Texts are cut into sentences, sentences are normalised and looked up among known licence sentences, and the sequence
of identifiers found in a text is matched against ordered licence rules: the first rule whose identifiers come in
this order takes its identifiers out, and later rules see what is left.

All is built-in functions.  The known sentences are a fixed table held in the plan, not joined; only texts with a
sentence that is known go on, and their sequences stay in the row, so nothing is exchanged at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between sentences, and sentences of well-known licences with their identifiers,
#: as normalised: lower case, every run of other characters than letters, digits and full stops one space.
SENTENCE_END = r"[.!?;:]+(?=[\s\"')\]]|$)|\n\s*\n"
#: A word that every known sentence holds one of.
KEYWORD = r"(?i)licen|permi|redistrib|warrant|reserved|domain|endorse"
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2.0": "apache-2-ref",
    "licensed under the apache license version 2.0 the license": "apache-2-ref",
    "apache license version 2.0": "apache-2-ref",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-obtain",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this work is licensed under the gnu general public license version 3": "gpl-3-ref",
    "licensed under the gnu general public license version 3": "gpl-3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl-2-ref",
    "licensed under the gnu general public license version 2": "gpl-2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl-2.1-later",
    "licensed under cc by 4.0": "cc-by-4-ref",
    "licensed under cc by sa 4.0": "cc-by-sa-4-ref",
    "licensed under cc by nc 4.0": "cc-by-nc-4-ref",
    "licensed under cc by nd 4.0": "cc-by-nd-4-ref",
    "licensed under cc by nc sa 4.0": "cc-by-nc-sa-4-ref",
    "licensed under cc by nc nd 4.0": "cc-by-nc-nd-4-ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-4-ref",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "cc-by-sa-4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "cc-by-nc-4-ref",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-grant",
    "all rights reserved": "all-rights",
}
#: Licence rules in order: longer and more specific before shorter.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-2-ref", "apache-use", "apache-obtain")),
    ("Apache-2.0", ("apache-2-ref",)),
    ("MIT", ("mit-ref",)),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-later",)),
    ("GPL-3.0-only", ("gpl-3-ref",)),
    ("GPL-2.0-only", ("gpl-2-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-ref",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("MPL-2.0", ("mpl-2-ref",)),
    ("Unlicense", ("unlicense-grant",)),
    ("CC0-1.0", ("cc0-grant",)),
    ("All-Rights-Reserved", ("all-rights",)),
]


def normalised(sentence: Column) -> Column:
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(lower, r"[^a-z0-9.]+", " "), r"^[ .]+|[ .]+$", "")


def sentence_ids(text: Column, sentences: Mapping[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order; sentences that are not known are left out.

    A sentence may run over lines; if it is not known as a whole, each of its lines is tried.  Only sentences with
    a key word are normalised.
    """
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])

    def found(sentence: Column) -> Column:
        return F.try_element_at(known, normalised(sentence))

    def tried(sentence: Column) -> Column:
        whole = F.array(found(sentence))
        lines = F.transform(F.filter(F.split(sentence, r"[\n\r]+"), lambda x: x.rlike(KEYWORD)), found)
        return F.when(F.get(whole, F.lit(0)).isNotNull(), whole).otherwise(lines)

    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda x: x.rlike(KEYWORD))
    return F.filter(F.flatten(F.transform(pieces, tried)), lambda i: i.isNotNull())


def licenses(ids: Column, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> Column:
    """Names of the licences whose rules match a sequence of identifiers, in the order of the rules, each once.

    A rule matches its identifiers where they follow each other; they are taken out before later rules are tried.
    """
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in wanted)).alias("wanted")) for name, wanted in rules
    ])
    start = F.struct(
        F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("rest"),
        F.array().cast("array<string>").alias("names"),
    )
    matched = F.aggregate(
        table, start,
        lambda acc, rule: F.when(
            F.contains(acc.getField("rest"), rule.getField("wanted")),
            F.struct(
                F.replace(acc.getField("rest"), rule.getField("wanted"), F.lit("#")).alias("rest"),
                F.array_append(acc.getField("names"), rule.getField("name")).alias("names"),
            ),
        ).otherwise(acc),
        lambda acc: F.array_distinct(acc.getField("names")),
    )
    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(matched)


def scan(
    docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, sentence_ids, licenses)``, one row per row of ``docs``.  Map-only.

    Texts that are null, empty or without a known sentence have empty arrays; repeated rows and ids are judged one by
    one.  Identifiers that no rule takes stand in ``sentence_ids`` only.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(sentence_ids(F.col(text_col), sentences))).alias("sentence_ids"))
    return ids.select("doc_id", "sentence_ids", licenses(F.col("sentence_ids"), rules).alias("licenses"))
