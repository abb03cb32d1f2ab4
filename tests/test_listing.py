"""Acts by a part of their title against a plain scan."""

from __future__ import annotations

import datetime
import random

from anchorspark.operators import listing


def test_search(spark):
    rnd = random.Random(4)
    words = ["NIS 2", "direktiv", "om", "kunstig", "intelligens", "AI", "Act", "KI-Verordnung", "a", "é"]
    title = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) if rnd.random() < 0.8 else None
    acts = [(f"3{rnd.randint(2018, 2024)}{rnd.choice('RLRLX')}{n}", title(), title(), title(), title(), datetime.date(2020, 1, 1 + n % 28) if n % 9 else None, rnd.choice([True, False, None])) for n in range(200)]
    acts += [acts[0], ("x", "NIS 2", "NIS 2", None, None, None, None)]
    asked = [(n, t, lo, hi, k, f) for n, (t, lo, hi, k, f) in enumerate([("nis2", 2018, 2024, "all", False), ("NIS 2", 2020, 2021, "directive", True), (" direktiv OM ", 2018, 2024, None, None), ("ki-", 2018, 2024, "regulation", False), ("a", 2018, 2024, "all", False), ("", 2019, 2019, "all", False), (None, 2018, 2018, "all", True), ("zzz", 2018, 2024, "all", False), ("2022r", 2018, 2024, "all", False), ("om", 2024, 2018, "all", False), ("kunstigintelligens", 2018, 2024, "all", False), ("kiverordnung", 2018, 2024, "all", False)])]
    table = spark.createDataFrame(acts, "celex string, title_da string, title_en string, title_de string, title_fr string, date date, in_force boolean")
    known = listing.listed(table)
    got = {}
    for r in listing.search(known, listing.index(known), spark.createDataFrame(asked, "query_id int, term string, year_from int, year_to int, kind string, in_force_only boolean")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.celex)
    for q, term, lo, hi, kind, forced in asked:
        t, want = (term or "").strip().lower(), []
        for celex, da, en, de, fr, date, force in set(acts):
            if celex[0] != "3" or celex[5] not in listing.LETTERS[kind or "all"] or not (da or en) or not lo <= int(celex[1:5]) <= hi or (forced and force is False):
                continue
            spaced, bare = [x.lower() for x in (da, en, de, fr) if x], [x.lower().replace(" ", "") for x in (da, en) if x]
            if any(t in x for x in spaced) or any(t.replace(" ", "") in x for x in bare) or t in celex.lower():
                want.append((date is None, -(date or datetime.date(1, 1, 1)).toordinal(), celex))
        assert got.get(q, []) == [c for *_, c in sorted(want)], (q, term)
    assert listing.search(known, listing.index(known), spark.createDataFrame([], "query_id int, term string, year_from int, year_to int, kind string, in_force_only boolean")).count() == 0
