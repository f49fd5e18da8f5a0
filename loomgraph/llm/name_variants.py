"""Variant spellings of people and organisations, linked to entities.

Method: weighted vectors of character n-grams, a distributed sparse cosine join with a prefix filter, a threshold, and
average-linkage clustering of each connected group of links.

* Organisations. Every organisation string of the graph (of people and of organisation nodes) is brought to one key. A
  mail or web domain belongs to one organisation, so a string stated beside a domain has that key, as has a string that
  begins with its name. The other strings are joined with all strings by cosine over n-grams of the leading word and the
  other words; the best partner that an edit distance confirms gives its key.
* People. The vectors are n-grams of the name within an organisation key, so that only people of one organisation meet;
  people with one e-mail address are linked as well. A pair is confirmed if family and given names agree up to typing
  errors, short forms, abbreviations, initials and order, and their addresses don't contradict.
* Grouping: components of the links, then average linkage of the cosines within each (absent or contradicted pairs count 0),
  where people with one address are one item. Rows alike in all that is compared are one before the join.
* Result: ``entities`` gives one row for each node with the smallest id of its entity; ``variant_pairs`` expands the
  entities to all pairs.

Cosine join: grams are ordered by weight, and a vector sends only its heaviest grams until the norm of the rest is below
the threshold: two vectors above the threshold share a gram among those. ``top`` keeps the best partners of each vector;
without it, as here, no partner is cut off.

Defined cases: null titles take the name in the properties; nodes without organisation and address have no partners;
properties that don't parse count as empty; deleted nodes are linked too; ties are broken by id.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.nicknames import SHORT_FORMS
from loomgraph.llm.personal import HONORIFICS, fold
from loomgraph.operators.components import connected_components
from loomgraph.runtime import ship_package, write_stage

ORG_GRAM, NAME_GRAM, ORG_COSINE, NAME_COSINE, LINKAGE = 4, 3, 0.3, 0.3, 0.15
_EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_WORD = re.compile(r"[^\W_]+")
# Words that organisation names gain or lose.
NOISE = frozenset("the hq intl international ev students of inc ltd".split())

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("emails", T.ArrayType(T.StringType())),
        T.StructField("mentioned", T.ArrayType(T.StringType())),
        T.StructField("domain", T.StringType()),
        T.StructField("orgs", T.ArrayType(T.StringType())),
    ]
)


def words(text: str) -> list[str]:
    return [fold(w) for w in _WORD.findall(text)]


def org_form(text: str) -> str:
    """Words of an organisation name without noise; the leading word is its own name."""
    t = words(text)
    if len(t) >= 3 and t[-2] == "of" and not close(t[-1], "studies"):
        t = t[-1:] + t[:-2]  # 'Group of X' is 'X Group'
    t = [w for w in t if w not in NOISE and len(w) > 1] or t
    return " ".join(t)


def person_form(text: str) -> str:
    """'given middle family', folded, from any order; '' if it holds no family name."""
    comma = [x for x in text.split(",") if x.strip()]
    parts = words(" ".join([*comma[1:], comma[0]])) if len(comma) == 2 else words(text)
    parts = [w for w in parts if w not in HONORIFICS]
    return " ".join(parts) if len(parts) >= 2 else ""


def _listed(value: object) -> list[str]:
    if isinstance(value, list):
        return [str(v) for v in value if v]
    return [x for x in re.split(r"\s*;\s*", value) if x] if isinstance(value, str) else []


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, kind, title, props in zip(*(b.column(c).to_pylist() for c in ("id", "node_type", "title", "properties")), strict=True):
            try:
                p = json.loads(props) if props else {}
            except ValueError:
                p = {}
            p = p if isinstance(p, dict) else {}
            raw = [x for x in (title, p.get("name"), *_listed(p.get("aliases"))) if isinstance(x, str)]
            if kind == "PERSON":
                contact = p.get("contact_info")
                values = list(contact.values()) if isinstance(contact, dict) else [contact]
                values = [v.strip().lower() for v in values if isinstance(v, str)]
                # an address that is a whole value is the person's own; one in running text is only another way to them
                emails = sorted({v for v in values if _EMAIL.fullmatch(v)})
                mentioned = sorted({e for v in values for e in _EMAIL.findall(v)} - set(emails))
                domain = (emails or mentioned)[0].split("@")[1].split(".")[0] if emails or mentioned else None
                org = p.get("organization")
                names = [f for x in dict.fromkeys(raw) if (f := person_form(x))]
                orgs = [f] if isinstance(org, str) and (f := org_form(org)) else []
            else:
                site = p.get("website")
                site = re.sub(r"^(?:https?://)?(?:www\.)?", "", site.strip().lower()) if isinstance(site, str) else ""
                domain, emails, mentioned, names = site.split(".")[0].split("/")[0] or None, [], [], []
                orgs = list(dict.fromkeys(f for x in raw if (f := org_form(x))))
            rows.append((i, kind, names, emails, mentioned, domain, orgs))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        texts = pa.list_(pa.string())
        kinds = [pa.string(), pa.string(), texts, texts, texts, pa.string(), texts]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=RECORD.names)


def cosine_pairs(grams: DataFrame, threshold: float, top: int | None = None) -> DataFrame:
    """(a, b, cosine) with a < b of all pairs at the threshold, or of those among the ``top`` partners of either end.
    ``grams`` has id and gram, distinct."""
    count = grams.groupBy("gram").agg(F.count("*").alias("df"))
    n_ids = grams.select("id").distinct().count() + 1
    weighted = grams.join(count.where("df > 1"), "gram", "left").select("id", "gram", F.log1p(F.lit(float(n_ids)) / F.coalesce("df", F.lit(1))).alias("w"))
    by_id = Window.partitionBy("id")
    heavy = by_id.orderBy(F.desc("w"), "gram").rowsBetween(Window.unboundedPreceding, -1)
    v = weighted.withColumns({"norm": F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_id)), "before": F.coalesce(F.sum(F.col("w") * F.col("w")).over(heavy), F.lit(0.0))})
    v = v.select("id", "gram", (F.col("w") / F.col("norm")).alias("w"), (1 - F.col("before") / (F.col("norm") * F.col("norm")) >= threshold * threshold).alias("prefix"))
    v = write_stage(v, "vectors").df
    left = v.where("prefix")
    # candidates meet at prefix grams; the cosine is then summed over all shared grams
    candidates = left.select(F.col("id").alias("a"), "gram").join(left.select(F.col("id").alias("b"), "gram"), "gram").where("a < b").select("a", "b").distinct()
    of = lambda s: v.select(F.col("id").alias(s), F.col("gram").alias("gram"), F.col("w").alias(f"w{s}"))
    pairs = candidates.join(of("a"), "a").join(of("b"), ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= threshold)
    if top is None:
        return pairs
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "cosine").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "cosine"))
    best = both.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("place") <= top)
    return best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "cosine").distinct()


def distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) between a and b, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
        if min(row) > most:
            return most + 1
    return one[-1]


def close(a: str, b: str) -> bool:
    return a == b or distance(a, b, k := 1 if max(len(a), len(b)) < 6 else 2) <= k


def same_org(a: str, b: str) -> bool:
    """Leading words one edit apart, and the other words close or cut short or left out; two edits if those are the same."""
    x, y = a.split(), b.split()
    rest_x, rest_y = x[1:], y[1:]
    if min(len(x[0]), len(y[0])) < 4 or distance(x[0], y[0], most := 2 if rest_x == rest_y and rest_x and len(x[0]) >= 6 else 1) > most:
        return False
    short, long = sorted((rest_x, rest_y), key=len)
    match = lambda p, q: close(p, q) or q.startswith(p[:4]) or p.startswith(q[:4]) or (p[0] == q[0] and len(p) >= 3 and all(c in q for c in p))
    return not short or all(any(match(p, q) for q in long) for p in short)


def same_given(a: str, b: str) -> bool:
    if a == b or (len(a) == 1 and b[0] == a) or (len(b) == 1 and a[0] == b):
        return True
    short, long = sorted((a, b), key=len)
    if len(short) >= 2 and long.startswith(short) and len(short) <= 4:
        return True
    full = lambda w: {w, *SHORT_FORMS.get(w, ())}
    if full(a) & full(b):
        return True
    return len(short) >= 3 and distance(a, b, 2) <= (1 if len(short) < 5 else 2)


def same_name(a: str, b: str) -> bool:
    """Whether two forms of names can be one person's: family and given names agree, in either order."""
    x, y = a.split(), b.split()
    for gx, fx in ((x[0], x[-1]), (x[-1], x[0])):
        for gy, fy in ((y[0], y[-1]), (y[-1], y[0])):
            if min(len(fx), len(fy)) >= 3 and close(fx, fy) and same_given(gx, gy):
                return True
    return False


def agree(a: tuple[list[str], list[str]], b: tuple[list[str], list[str]]) -> bool:
    """(names, emails) of two people of one organisation, or with one address."""
    (names_a, mails_a), (names_b, mails_b) = a, b
    if set(mails_a) & set(mails_b):
        return True
    if mails_a and mails_b:
        return False
    return any(same_name(x, y) for x in names_a for y in names_b)


def average_linkage(n: int, near: dict[tuple[int, int], float], apart: frozenset[int] = frozenset(), least: float = 0.5) -> list[int]:
    """Cluster number of each of n items; ``near`` holds the similarities above 0 of pairs i < j, all others are 0. No
    two items of ``apart`` come into one cluster.

    Merges the two clusters of the highest mean similarity until it is below ``least``; a heap with lazy deletion keeps
    it near-linear in the pairs.
    """
    size, to, lone = [1] * n, list(range(n)), [i in apart for i in range(n)]
    total: list[dict[int, float]] = [{} for _ in range(n)]
    heap = []
    for (i, j), s in near.items():
        total[i][j] = total[j][i] = s
        heap.append((-s, i, j))
    heapq.heapify(heap)
    while heap:
        s, i, j = heapq.heappop(heap)
        if j not in total[i] or -s != total[i][j] / (size[i] * size[j]):
            continue
        if -s < least:
            break
        del total[i][j], total[j][i]
        if lone[i] and lone[j]:
            continue
        lone[i] = lone[i] or lone[j]
        for k, v in total[j].items():
            del total[k][j]
            total[i][k] = total[k][i] = total[i].get(k, 0.0) + v
        total[j], size[i], to[j] = {}, size[i] + size[j], i
        for k, v in total[i].items():
            heapq.heappush(heap, (-v / (size[i] * size[k]), min(i, k), max(i, k)))

    def top(i: int) -> int:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    return [top(i) for i in range(n)]


def clusters_of(links: list[tuple[str, str, bool, float]], mailed: set[str]) -> list[tuple[str, str]]:
    """(id, cluster) from the links (a, b, same address, cosine) of one component: people with one address are one item,
    as near to another as the nearest of its people, and items with addresses of their own contradict each other."""
    ids = sorted({x for a, b, *_ in links for x in (a, b)})
    to = {i: i for i in ids}

    def top(i: str) -> str:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    for a, b, same, _ in links:
        if same:
            x, y = sorted((top(a), top(b)))
            to[y] = x
    items = sorted({top(i) for i in ids})
    at = {x: k for k, x in enumerate(items)}
    near = {}
    for a, b, same, cosine in links:
        x, y = sorted((at[top(a)], at[top(b)]))
        if not same and x != y:
            near[x, y] = max(near.get((x, y), 0.0), cosine)
    c = average_linkage(len(items), near, frozenset(at[top(i)] for i in mailed), LINKAGE)
    return [(i, items[c[at[top(i)]]]) for i in ids]


def _cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links sorted by the label of their component: (id, cluster) of its people."""
    label, links, mailed = None, [], set()
    out: list[tuple[str, str]] = []
    for b in batches:
        for r in b.itertuples(index=False):
            if r.label != label:
                out += clusters_of(links, mailed)
                label, links, mailed = r.label, [], set()
            links.append((r.a, r.b, bool(r.same), float(r.cosine)))
            mailed.update(x for x, m in ((r.a, r.mail_a), (r.b, r.mail_b)) if m)
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=["rep", "cluster"])
            out = []
    out += clusters_of(links, mailed)
    if out:
        yield pd.DataFrame(out, columns=["rep", "cluster"])


@F.pandas_udf(T.BooleanType())
def same_org_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_org(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def agree_udf(names_a: pd.Series, mails_a: pd.Series, names_b: pd.Series, mails_b: pd.Series) -> pd.Series:
    return pd.Series([agree((list(a), list(b)), (list(c), list(d))) for a, b, c, d in zip(names_a, mails_a, names_b, mails_b, strict=True)], dtype=bool)


def _ngrams(col, n: int):
    padded = F.concat(F.lit("^"), col, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n)))


def org_keys(records: DataFrame) -> DataFrame:
    """(org, key): one key for each organisation string."""
    stated = records.select(F.explode("orgs").alias("org"), "domain")
    head = F.substring_index("org", " ", 1)
    domains = records.where("domain is not null").select(F.col("domain").alias("head")).distinct().withColumn("is_domain", F.lit(True))
    strings = stated.groupBy("org").agg(F.count("*").alias("support"), F.min("domain").alias("low"), F.max("domain").alias("high")).withColumn("head", head)
    strings = strings.join(domains, "head", "left").select(
        "org", "support", "head", F.when(F.col("is_domain"), F.col("head")).when(F.col("low") == F.col("high"), F.col("low")).alias("known")
    )
    strings = write_stage(strings, "org-strings").df
    long = strings.where(F.length("head") >= 4)
    grams = long.select(F.col("org").alias("id"), F.explode(F.concat(_ngrams(F.col("head"), ORG_GRAM), F.expr("filter(transform(split(org, ' '), x -> concat('w:', x)), (x, i) -> i > 0)"))).alias("gram")).distinct()
    near = cosine_pairs(grams, ORG_COSINE)
    both = near.select(F.col("a").alias("org"), F.col("b").alias("other"), "cosine").union(near.select("b", "a", "cosine"))
    info = lambda s: strings.select(F.col("org").alias(s), F.col("known").alias(f"known_{s}"), F.col("support").alias(f"support_{s}"), F.col("head").alias(f"head_{s}"))
    better = (
        both.join(info("org").where("known_org is null"), "org")
        .join(info("other"), "other")
        .where((F.col("known_other").isNotNull() | (F.col("support_other") > F.col("support_org")) | ((F.col("support_other") == F.col("support_org")) & (F.col("other") < F.col("org")))))
        .where(same_org_udf("org", "other"))
        .groupBy("org")
        .agg(F.max_by(F.coalesce("known_other", "head_other"), F.struct(F.col("head_other") == F.col("head_org"), F.col("known_other").isNotNull(), "cosine", "support_other", "other")).alias("partner"))
    )
    return strings.join(better, "org", "left").select("org", F.coalesce("known", "partner", "head").alias("key"))


def entities(nodes: DataFrame) -> DataFrame:
    """(id, node_type, entity_id): each person and organisation node that has a name with the smallest id of its entity."""
    ship_package(nodes.sparkSession)
    wanted = nodes.where(F.col("node_type").isin("PERSON", "ORGANIZATION") & F.col("id").isNotNull()).select("id", "node_type", "title", "properties")
    records = write_stage(wanted.mapInArrow(_records, RECORD), "name-records").df
    keys = write_stage(org_keys(records), "org-keys").df
    by_org = records.select("id", F.explode_outer("orgs").alias("org")).join(keys, "org", "left").groupBy("id").agg(F.min("key").alias("key"))
    keyed = records.join(by_org, "id", "left").withColumn("key", F.coalesce("domain", "key"))
    keyed = write_stage(keyed.where("key is not null"), "name-keyed").df
    orgs = keyed.where("node_type = 'ORGANIZATION'").select("id", "key")
    firsts = orgs.groupBy("key").agg(F.min("id").alias("entity_id"))
    org_entities = orgs.join(firsts, "key").select("id", F.lit("ORGANIZATION").alias("node_type"), "entity_id")
    people = keyed.where("node_type = 'PERSON' and size(names) > 0").select("id", "names", "emails", "domain", "orgs", "key")
    # people alike in all that is compared are one from here on: however many copies there are, one of them is linked
    alike_in = F.struct(F.array_sort("names").alias("names"), F.array_sort("emails").alias("emails"), "domain", "orgs", "key")
    people = write_stage(people.withColumn("form", F.md5(F.to_json(alike_in))), "name-people").df
    reps = people.groupBy("form").agg(F.min("id").alias("rep"))
    member = people.select("id", "form").join(reps, "form").select("id", "rep")
    one = people.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").drop("form")
    # an organisation given by its initials alone: those people also meet all whose organisation has these initials
    initials = F.expr("aggregate(split(get(orgs, 0), ' '), '', (x, w) -> concat(x, substring(w, 1, 1)))")
    short = one.where("domain is null and size(orgs) > 0 and length(get(orgs, 0)) between 2 and 5 and instr(get(orgs, 0), ' ') = 0").select("id", F.get("orgs", F.lit(0)).alias("short"))
    spelled = one.where("size(orgs) > 0 and instr(get(orgs, 0), ' ') > 0").select("id", initials.alias("short")).join(short.select("short").distinct(), "short", "left_semi").select("id", "short")
    met = one.select("id", "key").union(short.union(spelled).select("id", F.concat(F.lit("initials:"), "short")))
    forms = F.flatten(F.transform("names", lambda n: F.flatten(F.transform(F.split(n, " "), lambda w: _ngrams(w, NAME_GRAM)))))
    grams = met.join(one.select("id", "names"), "id").select("id", F.explode(F.transform(F.array_distinct(forms), lambda g: F.concat_ws("|", "key", g))).alias("gram")).distinct()
    near = cosine_pairs(grams, NAME_COSINE)
    side = lambda s: one.select(F.col("id").alias(s), F.col("names").alias(f"names_{s}"), F.col("emails").alias(f"emails_{s}"))
    alike = near.join(side("a"), "a").join(side("b"), "b").where(agree_udf("names_a", "emails_a", "names_b", "emails_b")).select("a", "b", F.lit(False).alias("same"), (F.size("emails_a") > 0).alias("mail_a"), (F.size("emails_b") > 0).alias("mail_b"), "cosine")
    mails = one.select("id", F.explode("emails").alias("email"))
    first = mails.groupBy("email").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = mails.join(first.select("email", "a"), "email").where("id <> a").select("a", F.col("id").alias("b"), *(F.lit(True).alias(c) for c in ("same", "mail_a", "mail_b")), F.lit(1.0).alias("cosine"))
    links = write_stage(alike.union(shared), "name-links").df
    labels = connected_components(links).df
    placed = links.join(labels.select(F.col("id").alias("a"), "label"), "a").repartition("label").sortWithinPartitions("label", "a", "b")
    clustered = placed.mapInPandas(_cluster, "rep string, cluster string")
    final = write_stage(member.join(clustered, "rep", "left").select("id", F.coalesce("cluster", "rep").alias("cluster")), "name-clusters").df
    least = final.groupBy("cluster").agg(F.min("id").alias("entity_id"))
    return org_entities.unionByName(final.join(least, "cluster").select("id", F.lit("PERSON").alias("node_type"), "entity_id"))


def variant_pairs(nodes: DataFrame) -> DataFrame:
    """(id_a, id_b) of all pairs of nodes of one type that denote one entity."""
    e = write_stage(entities(nodes), "name-entities").df
    side = lambda c: e.select("node_type", "entity_id", F.col("id").alias(c))
    return side("id_a").join(side("id_b"), ["node_type", "entity_id"]).where("id_a < id_b").select("id_a", "id_b").distinct()
