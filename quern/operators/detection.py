"""Which catalogue device a browser's signals belong to, and what to answer: joins with the catalogue's keys, and group rules.

signals: a key, platform, type and ambiguous (of the device type), emulated, told (whether there is any signal), version,
model (that client hints name), legacy (that the agent names), same (whether headers agree), region and screen.

catalog: id, name, codes, aliases, platform, type, active, low and high (versions), support, conditions (scope, value, support),
confidence, question (kind, question, options of value and label). screens: screen and id, of the known screens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import rules
from quern.operators.catalogue import checkpointed, set_consensus, unique_keys
from quern.operators.intervals import version_join

ANSWER = ["method", "status", "confidence", "exact", "device", "candidates", "reasons", "clarification", "unknown_codes", "unknown_screen"]
OPTIONS = "array<struct<id:string,label:string>>"


def group_resolution(rows: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """One row per group of candidates: n, status, exact, code, reasons, question, and members.

    rows: id, name, r (as rules.device_resolution gives), conditions and question. All candidates of one status that isn't open give
    it, exactly if there is one candidate; all open ones agree on asking; else they disagree. reasons: each
    candidate's, in order, each once, where they agree. question: the candidates' own, where all have conditions of one
    scope and the same question with the same options. members: (id, name) in order.
    """
    own = F.col("question").isNotNull() & (F.size(F.array_distinct(F.transform("conditions", lambda c: c["scope"]))) == 1)
    asked = F.to_json(F.when(own, F.col("question")))
    member = F.struct(F.col(order).alias("_order"), F.col("id").alias("id"), F.col("name").alias("name"), F.col("r.reasons").alias("reasons"))
    told = rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.min("r.status").alias("lo"), F.max("r.status").alias("hi"), F.count(asked).alias("n_asked"), F.min(asked).alias("q_lo"), F.max(asked).alias("q_hi"),
        F.first(F.when(own, F.col("question")), ignorenulls=True).alias("q"), F.array_sort(F.collect_list(member)).alias("m"),
    )
    one = F.col("lo") == F.col("hi")
    agree = one & (F.col("lo") != rules.ASK)
    code = F.when(agree, "CANDIDATES_AGREE_ON_ESIM").when(one, "CANDIDATES_AGREE_ON_CLARIFICATION").otherwise("CANDIDATES_DISAGREE_ON_ESIM")
    reasons = F.when(agree, F.array_distinct(F.flatten(F.transform("m", lambda m: m["reasons"])))).otherwise(F.array().cast("array<string>"))
    shared = (F.col("n_asked") == F.col("n")) & (F.col("q_lo") == F.col("q_hi"))
    members = F.transform("m", lambda m: F.struct(m["id"].alias("id"), m["name"].alias("name")))
    return told.select(*group, "n", F.when(agree, F.col("lo")).otherwise(rules.ASK).alias("status"), (agree & (F.col("n") == 1)).alias("exact"), code.alias("code"), reasons.alias("reasons"), F.when(shared, F.col("q")).alias("question"), members.alias("members"))


def counted_groups(rows: DataFrame, group: str) -> DataFrame:
    """What group_resolution says of each group, without members: a row stands for n candidates that differ in id alone, first is the smallest of them.

    rows: the group, n, first, r, conditions and question. A group is aggregated in parts and never held as a whole; its row has n, first,
    status, exact, code, reasons and question, whatever the number of candidates.
    """
    own = F.col("question").isNotNull() & (F.size(F.array_distinct(F.transform("conditions", lambda c: c["scope"]))) == 1)
    asked = F.to_json(F.when(own, F.col("question")))
    told = rows.groupBy(group).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.min("r.status").alias("lo"), F.max("r.status").alias("hi"), F.sum(F.when(asked.isNotNull(), F.col("n"))).alias("n_asked"), F.min(asked).alias("q_lo"), F.max(asked).alias("q_hi"),
        F.first(F.when(own, F.col("question")), ignorenulls=True).alias("q"),
    )
    spots = rows.select(group, "first", F.posexplode("r.reasons").alias("place", "reason")).groupBy(group, "reason").agg(F.min(F.struct("first", "place")).alias("spot"))
    codes = spots.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("spot", "reason"))), lambda x: x["reason"]).alias("codes"))
    one = F.col("lo") == F.col("hi")
    agree = one & (F.col("lo") != rules.ASK)
    code = F.when(agree, "CANDIDATES_AGREE_ON_ESIM").when(one, "CANDIDATES_AGREE_ON_CLARIFICATION").otherwise("CANDIDATES_DISAGREE_ON_ESIM")
    shared = (F.col("n_asked") == F.col("n")) & (F.col("q_lo") == F.col("q_hi"))
    reasons = F.when(agree, F.col("codes")).otherwise(F.array().cast("array<string>"))
    return told.join(codes, group, "left").select(group, "n", "first", F.when(agree, F.col("lo")).otherwise(rules.ASK).alias("status"), (agree & (F.col("n") == 1)).alias("exact"), code.alias("code"), reasons.alias("reasons"), F.when(shared, F.col("q")).alias("question"))


def ask_for(kind: str | Column, question: str | Column, options: Column | None = None) -> Column:
    """A question to the user: kind, question, options (id, label)."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("kind"), lit(question).alias("question"), (F.lit(None) if options is None else options).cast(OPTIONS).alias("options"))


def answer_of(question: Column) -> Column:
    """A device's own question, to be answered."""
    return ask_for("answer_question", question["question"], F.transform(question["options"], lambda o: F.struct(o["value"].alias("id"), o["label"].alias("label"))))


def _codes(*parts: Column) -> Column:
    """The codes that aren't null, in order."""
    return F.filter(F.array(*parts), lambda c: c.isNotNull())


def _headers(same: Column) -> Column:
    return F.when(same, "SIGNAL_HEADERS_CONSISTENT").when(~same, "SIGNAL_HEADERS_INCONSISTENT")


def _open(signals: DataFrame, key: str, reasons: Column, clarification: Column) -> DataFrame:
    nothing = F.array().cast("array<string>")
    return signals.select(
        key, "platform", "type", F.lit("unknown").alias("method"), F.lit(rules.ASK).alias("status"), F.lit(0.0).alias("confidence"), F.lit(False).alias("exact"), F.lit(None).cast("string").alias("device"), nothing.alias("candidates"),
        reasons.alias("reasons"), clarification.alias("clarification"), nothing.alias("unknown_codes"), F.lit(None).cast("string").alias("unknown_screen"),
    )


def others(signals: DataFrame, key: str) -> DataFrame:
    """Suspected emulation, watches that run iOS, and platforms that are no mobile ones: always a question."""
    watch, other = F.col("type") == "watch", F.col("platform") == "other"
    base = F.when(F.col("told"), "PLATFORM_NOT_MOBILE").otherwise("NO_SIGNALS")
    reasons = _codes(F.when(F.col("emulated") | ~other, "PLATFORM_DETECTED").otherwise(base), F.when(F.col("emulated"), "EMULATION_SUSPECTED"))
    text = F.when(F.col("emulated"), "unconfirmed signals").when(watch, "watch").when(F.col("ambiguous"), "computer or tablet").otherwise("no mobile device")
    return _open(signals, key, reasons, ask_for("manual_input", text))


def android(signals: DataFrame, catalog: DataFrame, key: str, least: float = 0.8, derived: bool = True, unverified: bool = False) -> DataFrame:
    """The model that client hints name comes first, by code and then by alias; else the one that the agent names.

    Keys of several devices find none. The catalogue's sides are small, so Spark sends them to the signals while they are.
    """
    code = unique_keys(catalog.select("id", F.explode("codes").alias("c")), F.upper(F.trim("c")), "id")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "))
    alias = unique_keys(catalog.select("id", F.explode(F.concat("aliases", F.array("name"))).alias("a")), plain(F.col("a")), "id")
    hint = F.trim("model")
    found = signals.withColumns({"_model": F.when((hint != "") & (F.upper(hint) != "K"), hint), "_legacy": F.col("legacy")})
    for name in ("_model", "_legacy"):
        for what, keys, form in (("code", code, lambda c: F.upper(F.trim(c))), ("alias", alias, plain)):
            own = keys.select(F.col("key").alias("_key"), F.col("id").alias(f"{name}_{what}"))
            found = found.join(own, form(F.col(name)) == F.col("_key"), "left").drop("_key")
    by_model, by_legacy = (F.coalesce(f"{n}_code", f"{n}_alias") for n in ("_model", "_legacy"))
    found = found.withColumns({"_by_model": by_model, "_by_legacy": F.when(by_model.isNull(), by_legacy)}).withColumn("_device", F.coalesce("_by_model", "_by_legacy"))
    facts = catalog.select(F.col("id").alias("_device"), "support", "conditions", "question", F.col("confidence").alias("_data"), F.col("type").alias("_type"))
    j = found.join(facts, "_device", "left").withColumn("r", rules.device_resolution(F.col("support"), F.col("conditions"), F.col("_data"), F.col("question"), F.col("region"), F.col("version"), derived, unverified))
    known, model = F.col("_device").isNotNull(), F.col("_model").isNotNull()
    tried = F.col("_by_model").isNull() & F.col("_legacy").isNotNull()
    base = F.when(F.col("_by_model").isNotNull(), rules.BASES["code"]).otherwise(rules.BASES["legacy"])
    sure = F.when(known, rules.detection_confidence(base, F.col("same"))).otherwise(0.0)
    status = F.when(known, rules.answer_gate(F.col("r.status"), sure, least)).otherwise(rules.ASK)
    met = lambda c: F.when(c.isNotNull(), "CATALOG_EXACT_MATCH").otherwise("CATALOG_MODEL_CODE_UNKNOWN")
    first = _codes(F.lit("PLATFORM_DETECTED"), F.when(model, "UA_CH_MODEL_RECEIVED").otherwise("UA_CH_MODEL_MISSING_OR_GENERIC"), F.when(model, met(F.col("_by_model"))), F.when(tried, "LEGACY_UA_MODEL_PARSED"), F.when(tried, met(F.col("_by_legacy"))), F.when(known, _headers(F.col("same"))))
    low = F.when(known & (F.col("r.status") != rules.ASK) & (sure < least), "CONFIDENCE_BELOW_THRESHOLD")
    nothing = F.array().cast("array<string>")
    reasons = F.concat(first, F.when(known, F.col("r.reasons")).otherwise(nothing), _codes(low))
    text = F.when(F.col("type") == "watch", "watch").when(F.col("ambiguous"), "phone or tablet").when(F.col("type") == "tablet", "unknown tablet").otherwise("unknown device")
    clarification = F.when(~known, ask_for("manual_input", text)).when(F.col("r.question").isNotNull(), answer_of(F.col("r.question"))).when(status == rules.ASK, ask_for("check_on_device", "unconfirmed data"))
    unknown = F.when(~known, _codes(F.col("_model"), F.col("_legacy"))).otherwise(nothing)
    method = F.when(F.col("_by_model").isNotNull(), "model").when(F.col("_by_legacy").isNotNull(), "legacy").otherwise("unknown")
    return j.select(
        key, "platform", F.coalesce("_type", "type").alias("type"), method.alias("method"), status.alias("status"), sure.alias("confidence"), known.alias("exact"), F.col("_device").cast("string").alias("device"), nothing.alias("candidates"),
        reasons.alias("reasons"), clarification.alias("clarification"), unknown.alias("unknown_codes"), F.lit(None).cast("string").alias("unknown_screen"),
    )


def ios_candidates(asked: DataFrame, catalog: DataFrame, screens: DataFrame) -> DataFrame:
    """ask, id: the candidates of each different ask (ask, type, version, screen; a screen that isn't known is null).

    Devices of the screen within the version's range; where there are none, all of the screen; without a known screen, those of
    the range. Only active iOS devices of the type count, but the choice between the first two is made before.
    """
    fit = catalog.where("platform = 'ios' and active").select("id", "type", "low", "high")
    within = version_join(asked.select("type", "version").distinct(), fit, "version", "low", "high", ("type",)).select("type", "version", "id")
    seen = asked.where("screen is not null").join(screens.select("screen", "id").distinct(), "screen").select("ask", "type", "version", "id")
    two = seen.join(within.withColumn("_two", F.lit(True)), ["type", "version", "id"], "left")
    any_two = two.groupBy("ask").agg(F.max("_two").alias("any"))
    by_screen = two.join(any_two, "ask").where("any is null or _two").join(fit.select("id", "type"), ["id", "type"], "left_semi").select("ask", "id")
    return by_screen.unionByName(asked.where("screen is null").join(within, ["type", "version"]).select("ask", "id"))


def _fact_candidates(asked: DataFrame, catalog: DataFrame, screens: DataFrame) -> DataFrame:
    """ask, fact, n and first (the smallest id) of the candidates that ios_candidates gives, with support, conditions, confidence and question of the fact.

    Devices that are alike but for id and screen are one kind, and kinds with the same support, conditions, confidence and question one
    fact, so asks meet as many rows as the catalogue has different devices.
    """
    told = ["support", "conditions", "confidence", "question"]
    fit = catalog.where("platform = 'ios' and active").withColumn("fact", F.md5(F.to_json(F.struct(*told)))).withColumn("kind", F.md5(F.to_json(F.struct("type", "low", "high", "fact"))))
    kinds = checkpointed(fit.groupBy("kind", "type", "low", "high", "fact").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    within = version_join(asked.select("type", "version").distinct(), kinds, "version", "low", "high", ("type",)).select("type", "version", "kind", "fact", "n", "first")
    of_screen = screens.select("screen", "id").distinct().join(fit.select("id", "kind", "type", "fact"), "id").groupBy("screen", "kind", "type", "fact").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    # Devices of another type never are candidates, nor within a range of the asked type.
    seen = asked.where("screen is not null").select("ask", "type", "version", "screen").join(of_screen, ["screen", "type"])
    two = seen.join(within.select("type", "version", "kind", F.lit(True).alias("_two")), ["type", "version", "kind"], "left").select("ask", "fact", "n", "first", "_two")
    by_fact = two.groupBy("ask", "fact").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum(F.when(F.col("_two"), F.col("n"))).alias("n_two"), F.min(F.when(F.col("_two"), F.col("first"))).alias("first_two"))
    any_two = by_fact.groupBy("ask").agg(F.max("n_two").isNotNull().alias("any"))
    chosen = by_fact.join(any_two, "ask").select("ask", "fact", F.when(F.col("any"), F.col("n_two")).otherwise(F.col("n")).alias("n"), F.when(F.col("any"), F.col("first_two")).otherwise(F.col("first")).alias("first")).where("n is not null")
    ranged = within.groupBy("type", "version", "fact").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    met = chosen.unionByName(asked.where("screen is null").join(ranged, ["type", "version"]).select("ask", "fact", "n", "first"))
    return met.join(fit.groupBy("fact").agg(*[F.first(c).alias(c) for c in told]), "fact")


def _ios_asks(signals: DataFrame, screens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals with their type, ask and known screen, and the different asks: type, version, region and known screen, whatever the number of signals."""
    known = screens.select(F.col("screen").alias("_screen")).distinct()
    rows = signals.withColumn("type", F.when(F.col("type") == "tablet", "tablet").otherwise("phone")).join(known, F.col("screen") == F.col("_screen"), "left")
    rows = rows.withColumn("ask", F.to_json(F.struct("type", "version", F.upper(F.trim("region")).alias("region"), F.col("_screen").alias("screen"))))
    return rows, rows.select("ask", "type", "version", F.upper(F.trim("region")).alias("region"), F.col("_screen").alias("screen")).distinct()


def ios(signals: DataFrame, catalog: DataFrame, screens: DataFrame, key: str, least: float = 0.8, derived: bool = True, unverified: bool = False, listed: bool = True) -> DataFrame:
    """Groups are resolved once for each different type, version, region and known screen, of which there are few, whatever the number of signals.

    listed: each answer lists its candidates; else it has their group, n_candidates and first_candidate, as detect_grouped says.
    """
    rows, asked = _ios_asks(signals, screens)
    if listed:
        met = ios_candidates(asked, catalog, screens).join(catalog.select("id", "name", "support", "conditions", "confidence", "question"), "id")
    else:
        asked = checkpointed(asked)
        met = _fact_candidates(asked, catalog, screens)
    met = met.join(asked.select("ask", "version", "region"), "ask")
    met = met.withColumn("r", rules.device_resolution(F.col("support"), F.col("conditions"), F.col("confidence"), F.col("question"), F.col("region"), F.col("version"), derived, unverified))
    groups = group_resolution(met, ["ask"], "id") if listed else checkpointed(counted_groups(checkpointed(met), "ask"))
    groups = groups.withColumnsRenamed({c: f"_g_{c}" for c in groups.columns if c != "ask"})
    j = rows.join(groups, "ask", "left").withColumns({"_said": F.coalesce("_g_status", F.lit(rules.ASK)), "_code": F.coalesce("_g_code", F.lit("CANDIDATES_DISAGREE_ON_ESIM")), "_single": F.coalesce("_g_exact", F.lit(False))})
    agree = F.col("_said") != rules.ASK
    base = F.when(~agree, rules.BASES["disagree"]).when(F.col("version").isNotNull() & F.col("_screen").isNotNull(), rules.BASES["both"]).otherwise(rules.BASES["one"])
    sure = rules.detection_confidence(base, F.col("same"))
    status = rules.answer_gate(F.col("_said"), sure, least)
    first = _codes(F.lit("PLATFORM_DETECTED"), F.when(F.col("version").isNotNull(), "IOS_VERSION_IMPLIES_MIN_MODEL"), F.when(F.col("_screen").isNotNull(), "SCREEN_SIGNATURE_MATCHED").otherwise("SCREEN_SIGNATURE_UNKNOWN"), _headers(F.col("same")), F.col("_code"))
    nothing = F.array().cast("array<string>")
    reasons = F.concat(first, F.coalesce("_g_reasons", nothing), _codes(F.when(agree & (sure < least), "CONFIDENCE_BELOW_THRESHOLD")))
    if listed:
        ids = F.transform("_g_members", lambda m: m["id"].cast("string"))
        first_id = F.get(ids, F.lit(0))
        shown = [F.when(status == rules.ASK, F.coalesce(ids, nothing)).otherwise(nothing).alias("candidates")]
        choose = F.concat(F.transform("_g_members", lambda m: F.struct(m["id"].cast("string").alias("id"), m["name"].alias("label"))), F.array(F.struct(F.lit("__other__").alias("id"), F.lit("another model").alias("label"))))
    else:
        first_id, choose = F.col("_g_first").cast("string"), None
        open_ = (status == rules.ASK) & F.col("_g_n").isNotNull()
        shown = [F.when(open_, F.col("ask")).alias("group"), F.when(open_, F.col("_g_n")).otherwise(0).alias("n_candidates"), F.when(open_, first_id).alias("first_candidate")]
    asks = F.when(F.col("_g_n").isNull(), ask_for("manual_input", "unknown device")).when(F.col("_g_question").isNotNull(), answer_of(F.col("_g_question"))).otherwise(ask_for("choose_candidate", "which model", choose))
    return j.select(
        key, "platform", "type", F.lit("version and screen").alias("method"), status.alias("status"), sure.alias("confidence"), F.col("_single").alias("exact"), F.when(F.col("_single"), first_id).alias("device"), *shown,
        reasons.alias("reasons"), F.when(status == rules.ASK, asks).alias("clarification"), nothing.alias("unknown_codes"), F.when(F.col("_screen").isNull(), F.col("screen")).alias("unknown_screen"),
    )


def _told(signals: DataFrame) -> DataFrame:
    return signals.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("emulated", "ambiguous", "told")})


def _branches() -> tuple[Column, Column]:
    """Which signals, emulated ones aside, belong to android's branch and to that of ios."""
    return F.col("platform").isin("android", "harmonyos"), (F.col("platform") == "ios") & ~F.col("type").eqNullSafe("watch")


def detect(signals: DataFrame, catalog: DataFrame, screens: DataFrame, key: str, least: float = 0.8, derived: bool = True, unverified: bool = False) -> DataFrame:
    """One answer per signal, of the branch that its platform and type belong to.

    Columns: key, platform, type, method, status, confidence, exact, device, candidates (of open answers), reasons (codes), clarification (kind,
    question, options), and what moderation should see: unknown_codes and unknown_screen. Signals are read once and answers are checkpointed,
    so that answers and side outputs come from one run.
    """
    # The branches share one scan: what they read of signals is checkpointed.
    rows, (mobile, apple) = checkpointed(_told(signals)), _branches()
    rest = rows.where(F.col("emulated") | ~(mobile | apple))
    rows = rows.where(~F.col("emulated"))
    out = android(rows.where(mobile), catalog, key, least, derived, unverified).unionByName(ios(rows.where(apple), catalog, screens, key, least, derived, unverified)).unionByName(others(rest, key))
    return checkpointed(out)


def detect_grouped(signals: DataFrame, catalog: DataFrame, screens: DataFrame, key: str, least: float = 0.8, derived: bool = True, unverified: bool = False) -> tuple[DataFrame, DataFrame]:
    """The answers of detect with their candidates in a frame of their own: answers, and members (group, id, name).

    Lists in answers grow with signals times devices. Here an open answer has its group, n_candidates and first_candidate (the smallest id), and a
    question to choose a candidate has no options: they are the group's members, and one more for another model. Members are only made when they are read.
    """
    rows, (mobile, apple) = checkpointed(_told(signals)), _branches()
    rest = rows.where(F.col("emulated") | ~(mobile | apple))
    rows = rows.where(~F.col("emulated"))
    none = {"group": F.lit(None).cast("string"), "n_candidates": F.lit(0).cast("long"), "first_candidate": F.lit(None).cast("string")}
    out = android(rows.where(mobile), catalog, key, least, derived, unverified).unionByName(others(rest, key)).drop("candidates").withColumns(none)
    out = checkpointed(out.unionByName(ios(rows.where(apple), catalog, screens, key, least, derived, unverified, listed=False)))
    _, asked = _ios_asks(rows.where(apple), screens)
    open_ = asked.join(out.select(F.col("group").alias("ask")).where("ask is not null").distinct(), "ask", "left_semi")
    return out, ios_candidates(open_, catalog, screens).join(catalog.select("id", "name"), "id").select(F.col("ask").alias("group"), "id", "name")


def unknown_codes(answers: DataFrame, key: str) -> DataFrame:
    """code and key of each model that no device has, of signals that found none: what the task counter counts."""
    return answers.select(F.explode("unknown_codes").alias("code"), key, "platform")


def unknown_screens(answers: DataFrame, key: str) -> DataFrame:
    return answers.where("unknown_screen is not null").select(F.col("unknown_screen").alias("screen"), key)


def met_unknown_codes(signals: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """unknown_codes of the answers to signals, from the only branch that has any, without the other answers."""
    rows, (mobile, _) = _told(signals), _branches()
    return unknown_codes(android(rows.where(~F.col("emulated") & mobile), catalog, key), key)


def met_unknown_screens(signals: DataFrame, screens: DataFrame, key: str) -> DataFrame:
    """unknown_screens of the answers to signals: no answer, and so no list of candidates, is needed for them."""
    rows, (_, apple) = _told(signals), _branches()
    return rows.where(~F.col("emulated") & apple & F.col("screen").isNotNull()).join(screens.select("screen").distinct(), "screen", "left_anti").select("screen", key)


def signatures(catalog: DataFrame, screen: str, item: str, status: str) -> DataFrame:
    """screen, consensus and the ordered candidates of each screen."""
    return catalog.groupBy(screen).agg(set_consensus(F.col(status)).alias("consensus"), F.array_sort(F.collect_set(item)).alias("candidates"))


# Parts of agents that embedded views and browsers other than the usual ones name.
WEBVIEW = r"(?i); wv\)|webview"
BROWSERS = r"(?i)firefox|fxios|samsungbrowser|ucbrowser|opr/|opera|yabrowser|edga/"
CHROMIUM = r"(?i)chrome|chromium|edge"


def category(platform: Column, agent: Column, touch: Column, adapter: Column, mobile: Column, width: Column, height: Column, model: Column, brands: Column) -> Column:
    """The group of signals that a row belongs to for evaluation: the first that fits. brands: what client hints call the browser."""
    agent, phone = F.coalesce(agent, F.lit("")), platform.isin("android", "harmonyos")
    yes = lambda c: F.coalesce(c, F.lit(False))
    mac, hint = agent.rlike("(?i)macintosh"), F.lower(F.trim(model))
    side = F.when(width.isNotNull() & height.isNotNull(), F.least(width, height))
    tablet = agent.rlike("(?i)ipad") | (mac & yes(touch > 0)) | (phone & yes(F.when(mobile.isNotNull(), ~mobile).otherwise(side >= 600)))
    unusual = agent.rlike(BROWSERS) | (yes(F.size(brands) > 0) & ~yes(F.exists(brands, lambda b: b.rlike(CHROMIUM))))
    out = F.when(agent.rlike(WEBVIEW), "webview").when(rules.emulated(platform, touch, adapter), "devtools-emulation").when(mac & touch.isNull() & (platform == "other"), "ambiguous-signature").when(tablet, "tablet").when(platform == "ios", "iphone-generations")
    out = out.when(phone & yes((hint != "") & (hint != "k")), "android-vendor-ua-ch").when(unusual, "non-standard-browser").when(phone, "android-no-ua-ch")
    return out.when((platform == "other") & (agent != ""), "desktop-browser").otherwise("ambiguous-signature")
