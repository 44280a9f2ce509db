"""License statements found by ordered signature rules.

Every rule is a regular expression anchored at a keyword: only where a text has
one of the keywords are the words that follow matched at all, and only with that
keyword's rules. A detection inside the interval of a better one is suppressed:
better is the lower tier, within a tier the longer interval, then the earlier
rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import NOT_ALNUM, lower_az, split_words

#: phrase -> label; places of these are reported whatever the rules say.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: tier | label | keyword | what follows the keyword (words stand apart by one space). Tier 1: license text and identifiers, 2: name
#: with version, 3: name, 4: hint.
RULES = r"""
1 | spdx-tag | spdx | license identifier [0-9a-z]+
1 | mit | permission | is hereby granted free of charge to any person obtaining a copy
1 | isc | permission | to use copy modify and( or)? distribute this software for any purpose
1 | bsd-source | redistribution | and use in source and binary forms with or without modification
1 | bsd-3-clause | neither | the name of .{0,60}?nor the names of
1 | bsd-disclaimer | software | is provided by the copyright holders
1 | mit-disclaimer | software | is provided as is without warranty
1 | zlib | altered | source versions must be plainly marked
1 | gpl-grant | program | is free software you can redistribute it
1 | lgpl-grant | library | is free software you can redistribute it
1 | apache-2.0 | licensed | under the apache license version 2( 0)?
1 | mpl-2.0 | source | code form is subject to the terms of the mozilla public license
1 | epl-2.0 | accompanying | materials are made available under
1 | unlicense | unencumbered | software released into the public domain
1 | wtfpl | fuck | you want to public license
1 | bsl-1.0 | boost | software license version 1 0
1 | ms-pl | microsoft | public license ms pl
1 | ofl-1.1 | sil | open font license version 1 1
1 | gfdl | permission | is granted to copy distribute and or modify this document
1 | cc0-1.0 | cc0 | 1 0 universal
1 | artistic-2.0 | artistic | license 2 0
1 | bsd-4-clause | advertising | materials mentioning features or use of this software
1 | bsd-binary | redistributions | in binary form must reproduce the above copyright notice
1 | bsd-retain | redistributions | of source code must retain the above copyright notice
1 | mit-notice | above | copyright notice and this permission notice shall be included
1 | isc-disclaimer | author | disclaims all warranties with regard to this software
1 | agpl-grant | program | is licensed under the gnu affero general public license
1 | gpl-notice | you | should have received a copy of the gnu general public license
1 | lgpl-notice | you | should have received a copy of the gnu lesser general public license
1 | gpl-warranty | hope | that it will be useful but without any warranty
1 | apache-notice | distributed | on an as is basis without warranties or conditions of any kind
1 | apache-notice | unless | required by applicable law or agreed to in writing
1 | mpl-notice | copy | of the mpl was not distributed with this file
1 | zlib-origin | origin | of this software must not be misrepresented
1 | bsl-1.0-grant | permission | is hereby granted free of charge to any person or organization obtaining a copy
1 | postgresql-grant | permission | to use copy modify and distribute this software and its documentation for any purpose without fee
1 | cc-by-grant | licensed | under (a|the) creative commons attribution
1 | public-domain-grant | dedicated | to the public domain
1 | public-domain-grant | released | into the public domain
1 | beerware | buy | me a beer in return
1 | json | software | shall be used for good not evil
1 | php-notice | product | includes php software freely available from
1 | openssl-notice | product | includes software developed by the openssl project
1 | apache-1.1-notice | product | includes software developed by the apache software foundation
1 | ofl-reserved | reserved | font name
1 | bsl-1.1-change | change | date .{0,60}?change license
1 | elastic-limit | provide | the software to third parties as a hosted or managed service
2 | gpl-3.0 | gpl | v?3( 0)?( only| or later)?
2 | gpl-2.0 | gpl | v?2( 0)?( only| or later)?
2 | gpl-1.0 | gpl | v?1( 0)?( only| or later)?
2 | gpl-3.0 | gplv3 |
2 | gpl-2.0 | gplv2 |
2 | lgpl-3.0 | lgpl | v?3( 0)?( only| or later)?
2 | lgpl-2.1 | lgpl | v?2 1( only| or later)?
2 | lgpl-2.0 | lgpl | v?2( 0)?( only| or later)?
2 | lgpl-3.0 | lgplv3 |
2 | lgpl-2.1 | lgplv2 |
2 | agpl-3.0 | agpl | v?3( 0)?( only| or later)?
2 | agpl-3.0 | agplv3 |
2 | gpl-3.0 | gnu | general public license (as published .{0,60}?)?(either )?v(ersion)? ?3( 0)?
2 | gpl-2.0 | gnu | general public license (as published .{0,60}?)?(either )?v(ersion)? ?2( 0)?
2 | gpl-1.0 | gnu | general public license (as published .{0,60}?)?(either )?v(ersion)? ?1( 0)?
2 | lgpl-3.0 | gnu | lesser general public license (either )?v(ersion)? ?3( 0)?
2 | lgpl-2.1 | gnu | lesser general public license (either )?v(ersion)? ?2 1
2 | lgpl-2.0 | gnu | (library|lesser) general public license (either )?v(ersion)? ?2( 0)?
2 | agpl-3.0 | gnu | affero general public license (either )?v(ersion)? ?3( 0)?
2 | gfdl-1.3 | gnu | free documentation license v(ersion)? ?1 3
2 | gfdl-1.2 | gnu | free documentation license v(ersion)? ?1 2
2 | gfdl-1.1 | gnu | free documentation license v(ersion)? ?1 1
2 | apache-2.0 | apache | license (version |v)?2( 0)?
2 | apache-1.1 | apache | (software )?license (version |v)?1 1
2 | apache-1.0 | apache | (software )?license (version |v)?1 0
2 | apache-2.0 | apache | 2 0
2 | mpl-2.0 | mozilla | public license (version |v)?2( 0)?
2 | mpl-1.1 | mozilla | public license (version |v)?1 1
2 | mpl-1.0 | mozilla | public license (version |v)?1 0
2 | mpl-2.0 | mpl | v?2( 0)?
2 | mpl-1.1 | mpl | v?1 1
2 | epl-2.0 | eclipse | public license (version |v)?2( 0)?
2 | epl-1.0 | eclipse | public license (version |v)?1( 0)?
2 | epl-2.0 | epl | v?2 0
2 | epl-1.0 | epl | v?1 0
2 | eupl-1.2 | eupl | v?1 2
2 | eupl-1.1 | eupl | v?1 1
2 | eupl-1.2 | european | union public licen[cs]e (version |v)?1 2
2 | eupl-1.1 | european | union public licen[cs]e (version |v)?1 1
2 | cddl-1.1 | cddl | v?1 1
2 | cddl-1.0 | cddl | v?1 0
2 | cddl-1.0 | common | development and distribution license (version |v)?1 0
2 | cddl-1.1 | common | development and distribution license (version |v)?1 1
2 | cpl-1.0 | common | public license (version |v)?1 0
2 | bsd-2-clause | bsd | 2 clause
2 | bsd-3-clause | bsd | 3 clause
2 | bsd-4-clause | bsd | 4 clause
2 | bsd-0-clause | bsd | (0|zero) clause
2 | bsd-2-clause | simplified | bsd
2 | bsd-3-clause | new | bsd
2 | bsd-3-clause | modified | bsd
2 | bsd-2-clause | freebsd | license
2 | bsd-2-clause | 2 | clause bsd
2 | bsd-3-clause | 3 | clause bsd
2 | bsd-4-clause | 4 | clause bsd
2 | cc-by-4.0 | cc | by 4 0
2 | cc-by-3.0 | cc | by 3 0
2 | cc-by-2.5 | cc | by 2 5
2 | cc-by-2.0 | cc | by 2 0
2 | cc-by-1.0 | cc | by 1 0
2 | cc-by-sa-4.0 | cc | by sa 4 0
2 | cc-by-sa-3.0 | cc | by sa 3 0
2 | cc-by-sa-2.5 | cc | by sa 2 5
2 | cc-by-sa-2.0 | cc | by sa 2 0
2 | cc-by-nd-4.0 | cc | by nd 4 0
2 | cc-by-nd-3.0 | cc | by nd 3 0
2 | cc-by-nc-4.0 | cc | by nc 4 0
2 | cc-by-nc-3.0 | cc | by nc 3 0
2 | cc-by-nc-sa-4.0 | cc | by nc sa 4 0
2 | cc-by-nc-sa-3.0 | cc | by nc sa 3 0
2 | cc-by-nc-nd-4.0 | cc | by nc nd 4 0
2 | cc-by-nc-nd-3.0 | cc | by nc nd 3 0
2 | cc0-1.0 | cc | (0|zero) 1 0
2 | cc-by-4.0 | creative | commons attribution 4 0
2 | cc-by-3.0 | creative | commons attribution 3 0
2 | cc-by-sa-4.0 | creative | commons attribution share ?alike 4 0
2 | cc-by-sa-3.0 | creative | commons attribution share ?alike 3 0
2 | cc-by-nc-4.0 | creative | commons attribution non ?commercial 4 0
2 | cc-by-nc-3.0 | creative | commons attribution non ?commercial 3 0
2 | cc-by-nd-4.0 | creative | commons attribution no ?deriv(ative)?s? 4 0
2 | cc-by-nc-sa-4.0 | creative | commons attribution non ?commercial share ?alike 4 0
2 | cc-by-nc-nd-4.0 | creative | commons attribution non ?commercial no ?deriv(ative)?s? 4 0
2 | python-2.0 | python | software foundation license (version |v)?2
2 | php-3.01 | php | license (version |v)?3 01
2 | php-3.0 | php | license (version |v)?3 0
2 | zpl-2.1 | zope | public license (version |v)?2 1
2 | zpl-2.0 | zope | public license (version |v)?2 0
2 | afl-3.0 | academic | free license (version |v)?3 0
2 | osl-3.0 | open | software license (version |v)?3 0
2 | odbl-1.0 | open | database license (version |v)?1 0
2 | odc-by-1.0 | odc | by 1 0
2 | artistic-1.0 | artistic | license 1 0
2 | bsl-1.1 | business | source license (version |v)?1 1
2 | elastic-2.0 | elastic | license (version |v)?2( 0)?
2 | sspl-1.0 | server | side public license (version |v)?1
2 | unicode-dfs-2016 | unicode | license agreement data files and software
2 | cecill-2.1 | cecill | (version |v)?2 1
2 | cecill-2.0 | cecill | (version |v)?2 0
2 | cecill-b | cecill | b
2 | cecill-c | cecill | c
2 | lppl-1.3 | latex | project public licen[cs]e (version |v)?1 3[a-c]?
2 | lppl-1.3 | lppl | (version |v)?1 3[a-c]?
2 | ncsa | ncsa | open source licen[cs]e
2 | ms-rl | microsoft | reciprocal licen[cs]e
2 | qpl-1.0 | q | public licen[cs]e (version |v)?1 0
2 | ipl-1.0 | ibm | public licen[cs]e (version |v)?1 0
2 | npl-1.1 | netscape | public licen[cs]e (version |v)?1 1
2 | spl-1.0 | sun | public licen[cs]e (version |v)?1 0
2 | sissl | sun | industry standards source licen[cs]e
2 | apsl-2.0 | apple | public source licen[cs]e (version |v)?2 0
2 | cpal-1.0 | common | public attribution licen[cs]e (version |v)?1 0
2 | rpl-1.5 | reciprocal | public licen[cs]e (version |v)?1 5
2 | upl-1.0 | universal | permissive licen[cs]e (version |v)?1 0
2 | mulan-psl-2.0 | mulan | permissive software licen[cs]e (version |v)?2
2 | blueoak-1.0.0 | blue | oak model licen[cs]e 1 0 0
2 | polyform-nc-1.0 | polyform | noncommercial licen[cs]e 1 0 0
2 | pddl-1.0 | open | data commons public domain dedication
2 | ogl-uk-3.0 | open | government licen[cs]e (version |v)?3 0
2 | etalab-2.0 | licence | ouverte (version |v)?2 0
2 | w3c | w3c | software (and document )?(notice and )?licen[cs]e
2 | openldap-2.8 | openldap | public licen[cs]e (version |v)?2 8
2 | hpnd | historical | permission notice and disclaimer
3 | cecill | cecill | licen[cs]e
3 | lppl | latex | project public licen[cs]e
3 | ijg | independent | jpeg group
3 | libpng | libpng | licen[cs]e
3 | curl | curl | licen[cs]e
3 | perl | same | terms as perl
3 | tcl | tcl | tk licen[cs]e
3 | vim | vim | licen[cs]e
3 | intel | intel | open source licen[cs]e
3 | nvidia | nvidia | (software )?licen[cs]e
3 | fair | fair | licen[cs]e
3 | llama | llama | [0-9]? ?community licen[cs]e
3 | openrail | openrail | (m )?licen[cs]e
3 | gpl | gnu | general public licen[cs]e
3 | gpl | gnu | gpl
3 | gpl | gpl | licen[cs]ed?
3 | lgpl | gnu | (lesser|library) general public licen[cs]e
3 | lgpl | lgpl |
3 | agpl | gnu | affero general public licen[cs]e
3 | agpl | affero | general public licen[cs]e
3 | agpl | agpl |
3 | gfdl | gnu | free documentation licen[cs]e
3 | gfdl | gfdl |
3 | apache | apache | (software )?licen[cs]ed?
3 | mit | mit | (x11 )?licen[cs]ed?
3 | mit | expat | licen[cs]e
3 | x11 | x11 | licen[cs]e
3 | isc | isc | licen[cs]ed?
3 | bsd | bsd | (style )?licen[cs]ed?
3 | bsd | berkeley | software distribution licen[cs]e
3 | mpl | mozilla | public licen[cs]e
3 | mpl | mpl | licen[cs]ed?
3 | epl | eclipse | public licen[cs]e
3 | eupl | european | union public licen[cs]e
3 | cddl | common | development and distribution licen[cs]e
3 | cpl | common | public licen[cs]e
3 | cc-by | cc | by
3 | cc-by-sa | cc | by sa
3 | cc-by-nd | cc | by nd
3 | cc-by-nc | cc | by nc
3 | cc-by-nc-sa | cc | by nc sa
3 | cc-by-nc-nd | cc | by nc nd
3 | cc0 | cc0 |
3 | cc0 | cc | zero
3 | cc-by | creative | commons attribution
3 | cc-by-sa | creative | commons attribution share ?alike
3 | cc-by-nc | creative | commons attribution non ?commercial
3 | creative-commons | creative | commons (zero )?(public )?(domain )?licen[cs]ed?
3 | artistic | artistic | licen[cs]e
3 | zlib | zlib | (libpng )?licen[cs]e
3 | boost | boost | software licen[cs]e
3 | python | python | software foundation licen[cs]e
3 | php | php | licen[cs]e
3 | zope | zope | public licen[cs]e
3 | ofl | sil | open font licen[cs]e
3 | wtfpl | wtfpl |
3 | unlicense | unlicense |
3 | postgresql | postgresql | licen[cs]e
3 | openssl | openssl | licen[cs]e
3 | ruby | ruby | licen[cs]e
3 | ms-pl | microsoft | public licen[cs]e
3 | odbl | open | database licen[cs]e
3 | osl | open | software licen[cs]e
3 | afl | academic | free licen[cs]e
3 | elastic | elastic | licen[cs]e
3 | sspl | server | side public licen[cs]e
3 | beerware | beer | ?ware licen[cs]e
4 | all-rights-reserved | rights | reserved
4 | public-domain | public | domain
4 | copyright-notice | copyright | (c )?(19|20)[0-9][0-9]
4 | creative-commons | creative | commons
4 | proprietary | proprietary | (and confidential|software|licen[cs]e)
4 | licensed-under | licensed | under
"""

#: How much a detection of a tier says.
CONFIDENCE = {1: 0.99, 2: 0.95, 3: 0.9, 4: 0.4}


@dataclass(frozen=True)
class Rule:
    tier: int
    label: str
    keyword: str
    pattern: str


def parse_rules(text: str = RULES) -> list[Rule]:
    """One rule a line; the pattern is anchored at the keyword and at the end of a word."""
    out = []
    for line in text.strip().splitlines():
        tier, label, keyword, rest = (x.strip() for x in line.split("|", 3))
        out.append(Rule(int(tier), label, keyword, f"^{keyword}{' ' * bool(rest)}{rest}(?= )"))
    return out


def reach(rule: Rule) -> int:
    """Most words that a rule's pattern can match: one for each space, and every second character of a gap may be one."""
    gaps = re.findall(r"\.\{0,(\d+)\}", rule.pattern)
    return 1 + rule.pattern.removesuffix("(?= )").count(" ") + sum(int(n) // 2 + 1 for n in gaps)


def _rule_array(rules: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r.tier).alias("tier"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for n, r in enumerate(rules)])


def _phrase_at(words: Column, at: Column) -> Column:
    """Labels of the base phrases that begin at a word: at most one."""
    out = F.lit(None).cast("string")
    for phrase, label in PHRASES.items():
        out = F.when(_all_equal(words, at, phrase.split()), F.lit(label)).otherwise(out)
    return out


def _all_equal(words: Column, at: Column, phrase: list[str]) -> Column:
    test = F.get(words, at) == phrase[0]
    for j, w in enumerate(phrase[1:], 1):
        test = test & F.coalesce(F.get(words, at + j) == w, F.lit(False))
    return test


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with the findings added, each row on its own, without a shuffle.

    Added: n_words, base (array of (at, label): places where a base phrase's
    words stand), found (array of (at, to, n, tier, label): detections that
    stand, words at .. to-1, `n` is the rule), base_labels, labels (both
    distinct, sorted, comma-joined; the latter also has the rules' labels),
    score (0 without detections, else the chance that one is right, taking them
    as independent by tier). Words are runs of digits, a-z and non-ASCII
    characters after lowering A-Z. A null or empty text has no words and no
    findings. Repeated rows are handled alike; ties between equal intervals go to
    the earlier rule. Rules see as many words from their keyword on as its patterns
    can match. Added columns replace input columns of the same names.
    """
    rules = parse_rules() if rules is None else rules
    keywords = sorted({r.keyword for r in rules} | {p.split()[0] for p in PHRASES})
    reaches = {k: max((reach(r) for r in rules if r.keyword == k), default=1) for k in keywords}
    longest = max(reaches.values())
    reach_of = F.create_map(*[F.lit(v) for kv in reaches.items() for v in kv])
    added = ["n_words", "base", "found", "base_labels", "labels", "score"]
    worded = docs.drop(*added).withColumn("_words", split_words(lower_az(F.col(text_col)), NOT_ALNUM))
    words = F.col("_words")
    spots = worded.withColumn("_at", F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(keywords))).otherwise(F.array().cast("array<int>")))
    base = F.filter(F.transform("_at", lambda i: F.struct(i.alias("at"), _phrase_at(words, i).alias("label"))), lambda x: x["label"].isNotNull())
    near = F.transform("_at", lambda i: F.struct(i.alias("at"), F.get(words, i).alias("word"), F.concat(F.array_join(F.slice(words, i + 1, F.element_at(reach_of, F.get(words, i))), " "), F.lit(" ")).alias("near")))

    def detections(x: Column) -> Column:
        own = F.filter(_rule_array(rules), lambda r: r["keyword"] == x["word"])
        hits = F.filter(F.transform(own, lambda r: F.struct(r["n"].alias("n"), r["tier"].alias("tier"), r["label"].alias("label"), F.regexp_substr(x["near"], r["pattern"]).alias("hit"))), lambda h: h["hit"].isNotNull())
        return F.transform(
            hits, lambda h: F.struct(x["at"].alias("at"), (x["at"] + F.size(F.array_remove(F.split(h["hit"], " "), ""))).alias("to"), h["n"].alias("n"), h["tier"].alias("tier"), h["label"].alias("label"))
        )

    groups = spots.withColumn("base", base).withColumn("_groups", F.filter(F.transform(near, detections), lambda g: F.size(g) > 0))

    def inside(d: Column, o: Column) -> Column:
        """`o` contains `d` and is better."""
        length_d, length_o = d["to"] - d["at"], o["to"] - o["at"]
        better = (o["tier"] < d["tier"]) | ((o["tier"] == d["tier"]) & ((length_o > length_d) | ((length_o == length_d) & (o["n"] < d["n"]))))
        return (o["at"] <= d["at"]) & (o["to"] >= d["to"]) & better

    # An interval spans at most `longest` words, so only that many groups up to its own can contain it.
    standing = F.transform("_groups", lambda g, j: F.filter(g, lambda d: ~F.exists(F.flatten(F.slice("_groups", F.greatest(j + 2 - longest, F.lit(1)), F.least(j + 1, F.lit(longest)))), lambda o: inside(d, o))))
    done = groups.withColumn("found", F.flatten(standing))
    miss = F.aggregate("found", F.lit(1.0), lambda p, d: p * (F.lit(1.0) - F.element_at(F.create_map(*[F.lit(v) for kv in CONFIDENCE.items() for v in kv]), d["tier"])))
    return (
        done.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("base_labels", F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))), ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_union(F.transform("base", lambda b: b["label"]), F.transform("found", lambda d: d["label"]))), ","))
        .withColumn("score", F.lit(1.0) - miss)
        .drop("_words", "_at", "_groups")
    )
