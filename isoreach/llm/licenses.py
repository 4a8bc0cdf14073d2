"""License scans: Dice coefficient of word bigrams between a text's units and license templates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stash

#: The wording of public licenses and of their usual notices, by identifier.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-2.0-notice-url": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Dice coefficient, in hundredths, from which a unit counts as the license.
MIN_DICE = 80


def template_words(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of the normalised text, as normalised() and bigrams() make them."""
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normalised(text: Column) -> Column:
    """Lower case; every run of characters other than a-z, 0-9 and \\n becomes one space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\n]+", " ")


def words_of(unit: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(unit, "\n", " "), " "), "")


def anchors(sets: Mapping[str, list[str]], min_dice: int) -> list[str]:
    """Words of which every unit that matches a template holds one.

    A match shares at least min_dice / (200 - min_dice) of a template's bigrams, so it cannot lack all
    of a set of them that is larger than the rest; words are taken until so many bigrams hold one,
    by the number of these times the cube of the word's length, which puts telling words before common ones.
    """
    chosen: list[str] = []
    for grams in sets.values():
        may_lack = len(grams) - -(-min_dice * len(grams) // (200 - min_dice))
        left = [g.split() for g in grams if not set(g.split()) & set(chosen)]
        while len(grams) - len(left) <= may_lack:
            if not left:  # a match need not share any bigram
                return []
            best = min({w for g in left for w in g}, key=lambda w: (-(len(w) ** 3) * sum(w in g for g in left), w))
            chosen.append(best)
            left = [g for g in left if best not in g]
    return chosen


def clauses(grams: list[str], min_dice: int) -> list[list[str]]:
    """Disjoint lists of words, of each of which every unit that matches the template holds one.

    As with anchors(), a match cannot lack all words of a list if the bigrams that hold none of them are
    fewer than it shares. Lists are drawn up from the longest words on, for as long as words are left.
    """
    pairs = [set(g.split()) for g in grams]
    may_lack = len(pairs) - -(-min_dice * len(pairs) // (200 - min_dice))
    out: list[list[str]] = []
    while True:
        chosen: list[str] = []
        left = pairs
        while len(pairs) - len(left) <= may_lack:
            free = {w for g in left for w in g}.difference(*out)
            if not free:
                return out
            chosen.append(min(free, key=lambda w: (-(len(w) ** 3) * sum(w in g for g in left), w)))
            left = [g for g in left if chosen[-1] not in g]
        if not chosen:  # a match need not share any bigram
            return out
        out.append(chosen)


def license_runs(base: DataFrame, sets: Mapping[str, list[str]], lengths: Mapping[str, int], t: int) -> DataFrame:
    """Licenses in runs of consecutive lines of base (doc_id, norm), blank lines between them left out.

    For each template and line, of the runs from that line that have at most (200 - t) / t times the
    template's words, the one of largest coefficient (of equal ones the shortest) stands if it matches.
    In a text, taken by falling coefficient, a run goes that overlaps one taken before of the same template
    or of at least half as many shared bigrams. Runs that are a line, a paragraph or the whole text go last.
    """
    known = F.array(*[
        F.struct(F.lit(k).alias("license"), F.split(F.lit("\t".join(v)), "\t").alias("bigrams"), F.lit(len(v)).alias("size"),
                 F.lit(-(-t * len(v) // (200 - t))).alias("need"), F.lit((200 - t) * lengths[k] // t).alias("most"))
        for k, v in sets.items()])
    blank = lambda x: F.trim(x) == ""
    split = base.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("norm", "\n").alias("all"))
    at = lambda n: F.get(F.col("all"), n)
    line = lambda x, n: F.struct(
        n.alias("no"), words_of(x).alias("words"), ((n == 0) | blank(at(n - 1))).alias("opens"), ((n == F.size("all") - 1) | blank(at(n + 1))).alias("closes"))
    lines = split.where(F.size("all") > 1).select("doc_id", "row", F.filter(F.transform("all", line), lambda x: F.size(x["words"]) > 0).alias("lines"))
    # one element a word, with its place among the lines that are not blank
    word = lambda x, i: F.transform(x["words"], lambda w, j: F.struct(w.alias("w"), i.alias("i"), (j == 0).alias("starts"), x["no"].alias("no"), x["opens"].alias("opens"), x["closes"].alias("closes")))
    flat = lines.select("doc_id", "row", F.size("lines").alias("n_lines"), F.flatten(F.transform("lines", word)).alias("flat")).where("n_lines > 1")
    pairs = F.greatest(F.size("flat") - 1, F.lit(0))
    grams = F.zip_with(F.slice("flat", F.lit(1), pairs), F.slice("flat", F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a["w"], b["w"]))
    made = flat.select("*", grams.alias("grams")).select("*", F.array_distinct("grams").alias("distinct"))
    likely = F.filter(known, lambda k: (F.size("distinct") >= k["need"]) & (F.size(F.array_intersect(F.col("distinct"), k["bigrams"])) >= k["need"]))
    each = made.select("doc_id", "row", "n_lines", "flat", "grams", F.size("distinct").alias("n_distinct"), F.explode(likely).alias("k"))
    # a best run begins in a line that holds the first word of a template's bigram
    places = F.filter(F.transform("flat", lambda x, i: F.when(x["starts"], i)), lambda x: x.isNotNull())
    begun = F.array_distinct(F.transform(F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains(F.col("k.bigrams"), g), i)), lambda x: x.isNotNull()), lambda i: F.get(F.col("flat"), i)["i"]))
    placed = each.select("*", places.alias("places"), begun.alias("begun"))
    ahead = F.transform("begun", lambda i: F.struct(
        F.slice("grams", F.get(F.col("places"), i) + 1, F.col("k.most")).alias("grams"),
        F.slice("flat", F.get(F.col("places"), i) + 1, F.col("k.most") + 1).alias("flat")))
    ahead = F.filter(ahead, lambda c: F.size(F.array_intersect(c["grams"], F.col("k.bigrams"))) >= F.col("k.need"))
    starts = placed.select("doc_id", "row", "n_lines", "k", "places", "begun", F.explode(ahead).alias("c")).select("doc_id", "row", "n_lines", "k", "c.grams", "c.flat")
    # it ends with a whole line that holds the last word of one; the slice has one word more than a run may
    ends = F.array_distinct(F.filter(
        F.transform("grams", lambda g, i: F.when(F.array_contains(F.col("k.bigrams"), g), F.get(F.col("flat"), i + 1)["i"])),
        lambda j: j.isNotNull() & ((F.size("flat") <= F.col("k.most")) | (j < F.element_at("flat", -1)["i"]))))
    ended = starts.select("*", ends.alias("ends")).where("size(ends) > 0")
    cut = F.transform("ends", lambda j: F.struct(j.alias("j"), F.size(F.filter("flat", lambda x: x["i"] <= j)).alias("n_words")))
    cut = F.transform(cut, lambda c: F.struct(c["j"].alias("j"), c["n_words"].alias("n_words"), F.array_distinct(F.slice("grams", F.lit(1), F.greatest(c["n_words"] - 1, F.lit(0)))).alias("a")))
    cut = F.transform(cut, lambda c: F.struct(c["j"].alias("j"), c["n_words"].alias("n_words"), F.size(c["a"]).alias("n"), F.size(F.array_intersect(c["a"], F.col("k.bigrams"))).alias("shared")))
    cut = F.filter(cut, lambda c: 200 * c["shared"] >= t * (c["n"] + F.col("k.size")))
    best = F.array_min(F.transform(cut, lambda c: F.struct((F.lit(-2.0) * c["shared"] / (c["n"] + F.col("k.size"))).alias("minus"), c["j"].alias("j"), c["n_words"].alias("n_words"), c["n"].alias("n"), c["shared"].alias("shared"))))
    found = ended.select("doc_id", "row", "n_lines", "k", "flat", best.alias("b")).where("b is not null")
    first, last = F.get(F.col("flat"), F.lit(0)), F.get(F.col("flat"), F.col("b.n_words") - 1)
    whole = (first["i"] == 0) & (last["i"] == F.col("n_lines") - 1)
    paragraph = first["opens"] & last["closes"] & (last["no"] - first["no"] == last["i"] - first["i"])
    run = F.struct(
        F.col("b.minus").alias("minus"), (-F.col("b.shared")).alias("less"), F.col("k.license").alias("license"), first["i"].alias("first"), last["i"].alias("last"), first["no"].alias("no"),
        F.col("b.n").alias("n"), (whole | paragraph | (first["i"] == last["i"])).alias("unit"))
    # one row a text: row tells equal rows and null ids apart
    of_text = found.select("doc_id", "row", run.alias("r")).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    beaten = lambda kept, r: F.exists(kept, lambda x: (x["first"] <= r["last"]) & (r["first"] <= x["last"]) & ((x["license"] == r["license"]) | (2 * x["less"] <= r["less"])))
    taken = F.aggregate("rs", F.slice("rs", 1, 1), lambda kept, r: F.when(beaten(kept, r), kept).otherwise(F.concat(kept, F.array(r))))
    out = of_text.select("doc_id", F.explode(taken).alias("r")).where("not r.unit")
    return out.select("doc_id", F.lit("run").alias("unit"), F.col("r.no").cast("long").alias("unit_no"), "r.license", F.col("r.n").cast("long").alias("n_bigrams"), (-F.col("r.less")).cast("long").alias("n_shared"), (-F.col("r.minus")).alias("dice"))


def license_scan(docs: DataFrame, templates: Mapping[str, str] | None = None, min_dice: int = MIN_DICE) -> DataFrame:
    """Find licenses in whole texts: each unit of a text that is a license template, but for small changes.

    Units are every line; every paragraph, lines up to a blank one, that has two lines or more; and
    the whole text if it has two paragraphs or more; and runs of consecutive lines that are none of these,
    as license_runs() takes them. Blank means without a-z or 0-9. A unit matches a template
    if 100 * 2 * |A and B| >= min_dice * (|A| + |B|) for their sets of word bigrams, which needs |A| within min_dice / (200 - min_dice) of |B| either way; units outside these bounds for all
    templates are dropped before bigrams are made, and templates outside them before sets are met. So
    are texts that lack the words of all templates' clauses(), before anything is made of them, and units
    without any of the anchors(), which no match is without.

    docs: doc_id, text; other columns are ignored. Returned per matching unit: doc_id, unit ("line",
    "paragraph", "text", "run"), unit_no (from 0 among its kind, blank lines counted; a run's first line), license (the template of
    largest coefficient, ties to the smaller name), n_bigrams and n_shared long, dice double. A null or
    empty text has no match; a null doc_id stays null; repeated rows and units are each returned; an
    empty table gives no rows. A text of any length is held as its lines, its paragraphs and once whole.
    """
    bodies = templates or TEMPLATES
    sets = {k: template_bigrams(v) for k, v in sorted(bodies.items())}
    sets = {k: v for k, v in sets.items() if v}
    least, most = min(map(len, sets.values())), max(map(len, sets.values()))
    known = F.array(*[F.struct(F.lit(k).alias("license"), F.split(F.lit("\t".join(v)), "\t").alias("bigrams"), F.lit(len(v)).alias("size")) for k, v in sets.items()])
    t = min_dice
    blank = F.lit("\n(?: ?\n)+")
    words = anchors(sets, t)
    anchored = lambda c: F.arrays_overlap(F.split(c, "[ \n]"), F.array(*[F.lit(w) for w in words])) if words else F.lit(True)
    # which words of the templates' clauses a text holds is found in one pass over its words
    lists = {k: clauses(v, t) for k, v in sets.items()}
    array = lambda ws: F.array(*[F.lit(w) for w in ws])
    telling = sorted({w for listed in lists.values() for ws in listed for w in ws})
    held = F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+"), array(telling) if telling else F.array().cast("array<string>"))
    possible = reduce(or_, [reduce(and_, [F.arrays_overlap("held", array(ws)) for ws in listed], F.lit(True)) for listed in lists.values()])
    likely = docs.select("doc_id", "text", F.explode(F.array(held)).alias("held")).where(possible)
    base = Stash(likely.select("doc_id", normalised(F.col("text")).alias("norm")), "licenses").df
    lines = F.split("norm", "\n")
    paragraphs = F.split(F.regexp_replace("norm", blank, F.lit("\r")), "\r")
    unit = "array<struct<unit:string,unit_no:int,body:string>>"
    made = F.concat(
        F.transform(lines, lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("unit_no"), x.alias("body"))).cast(unit),
        F.filter(F.transform(paragraphs, lambda x, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("unit_no"), x.alias("body"))).cast(unit), lambda u: F.trim(u["body"]).contains("\n")),
        F.when(F.col("norm").rlike("\n(?: ?\n)+"), F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), F.col("norm").alias("body")))).otherwise(F.array()).cast(unit),
    )
    units = base.select("doc_id", F.explode(made).alias("u")).select("doc_id", "u.*")
    # a set of n bigrams needs n + 1 words at least, and so a length of 2n + 1
    sized = units.where(anchored(F.col("body"))).where(F.length("body") >= 2 * -(-t * least // (200 - t)) + 1).withColumn("words", words_of(F.col("body")))
    sized = sized.where((F.size("words") - 1) * (200 - t) >= t * least)
    # the optimizer may evaluate this for units that the conditions drop, so the length is bounded here too
    pairs = F.greatest(F.size("words") - 1, F.lit(0))
    grams = F.array_distinct(F.zip_with(F.slice("words", F.lit(1), pairs), F.slice("words", F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a, b)))
    bounded = sized.select("doc_id", "unit", "unit_no", grams.alias("grams")).withColumn("n", F.size("grams"))
    bounded = bounded.where((F.col("n") * (200 - t) >= t * least) & (F.col("n") * t <= (200 - t) * most))
    near = F.filter(known, lambda k: (F.col("n") * (200 - t) >= t * k["size"]) & (F.col("n") * t <= (200 - t) * k["size"]))
    met = F.transform(near, lambda k: F.struct(F.size(F.array_intersect(F.col("grams"), k["bigrams"])).alias("shared"), k["size"].alias("size"), k["license"].alias("license")))
    hits = F.filter(met, lambda m: 200 * m["shared"] >= t * (F.col("n") + m["size"]))
    # the order of the fraction 2 * shared / (n + size) as doubles, ties to the smaller name
    dice = lambda m: F.lit(2.0) * m["shared"] / (F.col("n") + m["size"])
    best = F.array_min(F.transform(hits, lambda m: F.struct((-dice(m)).alias("minus"), m["license"].alias("license"), m["shared"].alias("shared"))))
    alone = bounded.withColumn("best", best).where("best is not null").select(
        "doc_id", "unit", F.col("unit_no").cast("long").alias("unit_no"), F.col("best.license").alias("license"),
        F.col("n").cast("long").alias("n_bigrams"), F.col("best.shared").cast("long").alias("n_shared"), (-F.col("best.minus")).alias("dice"),
    )
    return alone.unionByName(license_runs(base, sets, {k: len(template_words(bodies[k])) for k in sets}, t))
