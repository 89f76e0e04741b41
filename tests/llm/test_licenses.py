import re

import pytest

from tessera.llm import licenses as M
from tessera.llm.licenses import BASE, Index, license_scan, scan, word_frequencies


def _brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(i, label) for p, label in BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


TEXTS = ["Under the MIT License, under-the mit_license. CC BY-NC; cc by nc cc by nc",
         "Apache License, Version 2.0 apache license version 20", "été CC\x00BY NC mit license", "under the mit",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
         "documentation files (the \"Software\"), to deal in the Software without restriction",
         "Permission is hereby granted, free of charge, by nobody", "the license of the mit " * 300,
         "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
         "compliance with the License. You may obtain a copy of the License at"]


@pytest.mark.parametrize("block", [20, 1 << 20])
def test_base_places_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    index = Index.of({}, 10)
    for text in TEXTS + [" ".join(TEXTS) * 3]:
        n, places, _ = scan(text, index)
        starts = [a for _, a in places]
        assert (n, len(places), min(starts, default=None), max(starts, default=None),
                ",".join(sorted({index.templates[t].label for t, _ in places}))) == _brute(text)


def test_query_over_edges(spark, edge_docs, edge_rows):
    rows = edge_rows + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = license_scan(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == \
        sorted(((i, *_brute(t)) for i, t in rows), key=repr)
    by = {r.doc_id: r for r in got}
    assert by[104].labels == "mit" and by[104].base_labels == "" and by[104].score > 0.9
    assert by[105].labels == "" and by[105].score == 0.0          # key phrase missing
    assert "apache-2" in by[107].labels and by[100].score == 1.0
    assert len(license_scan(edge_docs).collect()) == len(edge_rows)


def test_frequencies_count_every_document(spark):
    docs = spark.createDataFrame([(1, "mit MIT license"), (2, "license"), (3, None)], "doc_id long, text string")
    df, n = word_frequencies(M.id_text(docs))
    assert n == 3 and df[b"license"] == 2 and df[b"mit"] == 1


def test_empty_table(no_docs):
    assert license_scan(no_docs).count() == 0


BSD = """Copyright (c) 2020, A. Author. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY."""
ENDORSE = """Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
GNU = ("This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public "
       "License as published by the Free Software Foundation, either version {} of the License, or (at your option) any "
       "later version.")
CC = 'This work is licensed under a Creative Commons {} 4.0 International License.'
STANDARD = [
    ("bsd-2-clause", BSD + DISCLAIMER),
    ("bsd-3-clause", BSD + "3. " + ENDORSE.format("the copyright holder") + DISCLAIMER),
    ("bsd-3-clause", BSD.replace("1.", "*").replace("2.", "*") + ENDORSE.format("the University of A and B") + DISCLAIMER),
    ("bsd-3-clause", BSD + "3. The name of the author may not be used to endorse or promote products derived from this "
                     "software without specific prior written permission.\n" + DISCLAIMER),
    ("bsd-4-clause", BSD + "3. All advertising materials mentioning features or use of this software must display the "
                     "following acknowledgement: This product includes software developed by the University.\n4. "
                     + ENDORSE.format("the University") + DISCLAIMER),
    ("bsd-2-clause,bsd-3-clause", BSD + DISCLAIMER + BSD + "3. " + ENDORSE.format("the copyright holder") + DISCLAIMER),
    ("gpl-2", GNU.format("program", "", "2")), ("gpl-3", GNU.format("program", "", "3")),
    ("lgpl-2.1", GNU.format("library", "Lesser ", "2.1")), ("lgpl-3", GNU.format("library", "Lesser ", "3")),
    ("lgpl-3", GNU.format("program", "Lesser ", "3")), ("agpl-3", GNU.format("program", "Affero ", "3")),
    ("mit", TEXTS[4] + ", including without limitation the rights to use, copy, modify, merge, publish"),
    ("mit", "Released under the MIT License. See the LICENSE file for details."),
    ("apache-2", TEXTS[7] + " http://www.apache.org/licenses/LICENSE-2.0"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
              "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy it."),
    ("cc-by", CC.format("Attribution")), ("cc-by-nc", CC.format("Attribution-NonCommercial")),
    ("cc-by-sa", CC.format("Attribution-ShareAlike")),
    ("cc0", "To the extent possible under law, A. Author has waived all copyright and related or neighboring rights to "
            "This Work. CC0 1.0 Universal Public Domain Dedication")]


@pytest.mark.parametrize("block", [50, 1 << 20])
@pytest.mark.parametrize("label,text", STANDARD)
def test_notices_on_their_standard_text(monkeypatch, block, label, text):
    monkeypatch.setattr(M, "BLOCK", block)
    index = Index.of({}, 10)
    for x in (text, "some words before " * 30 + text + " and some words after" * 30):
        _, places, scores = scan(x, index)
        assert ",".join(sorted(set(scores) | {index.templates[t].label for t, _ in places})) == label
