"""Labels of short match chat by 21 prioritised categories: sentiment, six kinds of toxicity, jargon and ambiguity.

The word tables are data: ``load_tables`` reads others of the same names from a JSON file.  The categories are expressions; the first
that applies labels the message, and everything stays in one projection without Python.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from embertrace.functions import text as T
from embertrace.operators.rules import TOX

# fmt: off
#: The words of each category, separated by ", ".
WORDS: dict[str, str] = {
    "insult": (
        "noob, noobs, newb, newbs, noobie, trash, idiot, idiots, dumb, stupid, loser, losers, retard, retards, tard, tards, useless, feeder, feeders, griefer, "
        "griefers, clown, clowns"
    ),
    "ez": (
        "ez, ezz, ezzz, ezzzz, eazy, easy, ezpz, ezgg, ggez"
    ),
    "ff": (
        "ff, ggff, ffgg, ffs, forfeit, 25ff, 30ff, ff25, ff30"
    ),
    "sport": (
        "wp, wps, wpwp, nice, niice, niiice, nicee, niceee, nice play, nice plays, np, gj, goodgame, good game, well played, nicely played, good job, nice one, "
        "nice job, gj guys, wp guys, gl, glhf, gl hf, good luck, have fun, thx, ty, thanks, thank you, tysm, tyvm, gn, gngn, good night, hf, hf!, hf gl, gl hf "
        "boys, g try, go try, good try, gt, gtgt, g g, gg gl, gl next, gl further, gn next, next game, no worries, nvm, no problem, no prob, all good, ok np, k "
        "np, close game, close, close one, f, gfg, respect, respects, u2, you too, same to you, me too, same, sama, u 2, y2, ggl, g3g3, gygy, grats, congrats, "
        "gz, gz wp, ggwp gz, mantap, mantul, mantab, mantaab, anjay, anjayy, anjaay, mabar, yuk mabar, ayok mabar, gas mabar, maaf, yamaap, yamap, ya maaf, ya "
        "maap, ya map, punten, mksh, mksih, makasih, makasihh, thx ya, thx ya bro, sabar, sabar bro, sabar bg, sabar bang, tenang, santai, takpe, takpe bro, "
        "takpe bang, ga papa, gapapa, no problemo, full chill, chill bro, chill, santai bro, santai bg, masuk terus, gas terus, lanjut bro, sip, sippp, sipp"
    ),
    "obscene": (
        "fuck, fucking, fucked, fk, fck, fuk, fak, wtf, wth, omfg, shit, shitty, sht, crap, damn, damnit, dammit, goddamn, gd, bullshit, bs, fml, jfc, omg, "
        "omgg, omggg"
    ),
    "target": (
        "you, u, ur, your, yall, yourself"
    ),
    "apology": (
        "sry, sryy, sryyy, srry, sorry, sorryy, soryy, sorri, my bad, mb, mybad, my fault, mf, apologies, g sry, sry g, srry g, sry guys, sorry guys"
    ),
    "ack": (
        "k, kk, kkk, ok, okk, okay, okayy, y, yy, yes, yess, yep, yea, yea boi, ya, ye, yeah, n, no, nope, nah, nope nope, rdy, rdyy, ready, imready, im ready, "
        "rdy?, ready?, r, p, ts"
    ),
    "ack_ambiguous": (
        "r, p, k, y, n, ts, ya"
    ),
    "timer": (
        "sec, secs, second, seconds, 1 sec, 2 sec, 5 sec, 10 sec, 30 sec, 30s, 60s, 1s, 2s, 5s, 10s, wait, w8, w8t, wait pls, wait please, 1 min, 2 min, 3 min, "
        "5 min, min, minute, minutes, soon, almost, 1 sec pls, sec pls"
    ),
    "tech": (
        "lag, lags, lagg, lagging, lagged, lagspike, lag spike, lag sry, lag sorry, lagg sry, sec lag, lag sec, mic, no mic, mic check, mic test, mic?, mic ok, "
        "ping, high ping, ping issue, -ping, crash, crashed, client crash, game crash, pause, paused, pause pls, pause please, pause?, unpause, settings, "
        "setting, settings pls, dc, disconnect, disconnected, reconnect, rc, fps, low fps, lag fps, loading, load, loaded, black screen, blackscreen, packet "
        "loss, packet, packets, headset, mouse, keyboard, ds lag, discord, discord prob, discord prob sry, hang, hanged, hanging, freeze, frozen, rec, "
        "recording, wc, internet, wifi, router, reset, reboot, restart, ds, issue, issues, log in, login, log out, alt tab, alt-tab, delay, delays, delayed, "
        "delaying, input delay, input lag, stuttering, stutter, stutters, freezing, freezed"
    ),
    "react_negative": (
        "sad, aw, aww, awww, oh no, ohno, noo, nooo, noooo"
    ),
    "react_loss": (
        "loss, lose, lost"
    ),
    "gg_start": (
        "gg, ggwp, ggs, gege, gw, gwp"
    ),
    "gg_phonetic": (
        "gee gee, gee gee gee, geegee, gigi, gigi gigi, jiji, jijiji, gigigi, geegeege"
    ),
    "sport_token": (
        "gl, hf, wp, gj, np, ty, thx, thanks, tysm, tyvm, glhf, gz, gratz, congrats, grats, respect, respects"
    ),
    "apology_token": (
        "sry, sryy, sryyy, srry, sorry, sorryy, soryy, mb, mybad"
    ),
    "tech_token": (
        "lag, lags, lagg, lagging, crash, crashed, pause, paused, mic, ping, fps, disconnect, disconnected, dc, reconnect, rc, delay, delays, delayed, freeze, "
        "frozen, stutter, hang, hanged, loading, load, rec, settings, setting"
    ),
    "foreign": (
        "kontol, kontoll, kontolll, kntl, k0ntol, memek, mmk, mmek, biji, bijik, ngentot, ngentod, ngentodt, ngetot, kentu, ngewe, anjing, anjir, anjr, anjg, "
        "njir, anjeng, anjeg, anjink, asu, asuw, asw, asoo, asoooo, babi, monyet, monyong, babiat, bbi, bangsat, bgst, bgsd, bnsdt, bsndt, bansat, bjingan, "
        "bajingan, bjg, jancok, jancuk, jncok, cuk, goblok, gblk, goblg, tolol, tll, pekok, pkk, bobrok, bobok, tai, taik, tahi, thai, bacot, bcot, bct, "
        "bacotan, ngebacot, bacotin, bacooot, bacooootttt, ngebacooottt, ngebacotttt, bcttt, bacod, bcod, ngebacod, bacodin, ndasmu, ndas, kontolmu, memekmu, "
        "asumu, pukimak, puki, pukima, bgsdt, bsd, blyat, blat, blya, suka, pidor, pidoras, pizdec, huy, huyna, ebal, yebat, nahuy, loh, lokh, uebok, uebki, "
        "lohi, huesos, mudak, mudaki, duraki, durak, puta, putangina, putang ina, tanga, bobo, ulol, gago, pi, putik, lintik, tarantado, kupal, hayop, siraulo, "
        "leche, salbahe, kamukha, maricon, maricone, marica, puto, pendejo, cabron, cabrón, joder, mierda, carajo, pinche, huevon, chinga, chingada, scheisse, "
        "scheise, arschloch, wichser, kurwa, kurwo, skurwysyn, jebac, pierdole, putain, merde, salope, connard, enculé, encule, faggot, fag, nigger, nigga, "
        "chink, gook, spic, kike, tranny, dyke, sob"
    ),
    "identity": (
        "maricon, maricone, marica, faggot, fag, tranny, dyke, nigger, nigga, chink, gook, spic, kike"
    ),
    "coord": (
        "back, b, bb, backk, back back, go back, fall back, retreat, miss, mia, ss, ss mid, ss top, ss bot, mid miss, top miss, bot miss, missing, mid missing, "
        "top missing, bot missing, care, careful, beware, watchout, watch out, smoke, smoke up, smoking, smoke now, smoke?, push, pushing, push mid, push top, "
        "push bot, push now, def, defend, defend base, hold, hold base, farm, gank, ganking, gnk, gank mid, gank top, gank bot, rosh, roshan, aegis, cheese, "
        "rosh now, rosh?, rune, runes, top rune, bot rune, tower, tower mid, tower top, tower bot, t1, t2, t3, t4, racks, rax, mid rax, top rax, bot rax, mid, "
        "top, bot, bottom, jungle, safelane, offlane, off, safe, mid lane, top lane, bot lane, bottom lane, bkb, manta, bf, battlefury, vlad, pipe, meka, eul, "
        "force, glimmer, lotus, shard, aghs, agh, aghanim, midas, octarine, aether, hex, blink, drum, wand, stick, oom, low, low hp, low mana, no mana, no "
        "ulti, no ult, ult, ulti, ulty, have ult, cd, cooldown, buyback, bo, no bb, have bb, no buyback"
    ),
    "coord_ambiguous": (
        "low, back, b, bb, safe, off, hold, def, bo, farm"
    ),
    "init": (
        "g, go, goo, gooo, now, init, initiate, engage, go go, go go go, go now, lets go, let's go, letsgo, go!, go?"
    ),
}
#: Spellings with swapped or repeated letters.
FUZZY = [
    r"\bng[ae]nt[o0]+[dt]+\b", r"\bk[o0]nt[o0]l+\b", r"\bm[ae]m[ae]k+\b", r"\bg[o0]bl?[o0]k+\b", r"\bt[o0]l[o0]l+\b", r"\banjing+\b", r"\banj[ir]+r?\b",
    r"\bbangs?[ad]t+\b|\bbgs[dt]+\b", r"\bj[ae]nc[ou]k+\b", r"\bbac[oa]+[td]+\b", r"\bngebac[oa]+[td]+\b", r"\banj[ei]ng+\b|\banj[ei]g+\b",
    r"\bp[uo]kim[ae]k+\b", r"\bpekok+\b", r"\btahi+\b|\btaik+\b", r"\bbabi+\b", r"\bmonyet+\b|\bmonyong+\b",
]
#: Insults of several words.
PHRASES = [
    r"\banak\s+haram\b", r"\bputang\s*ina\b", r"\bhijo\s+de\s+puta\b", r"\bpinche\s+puto\b", r"\bmother\s*fucker\b|\bmotherfucker\b",
    r"\bson\s+of\s+a?\s*bitch\b|\bsob\b",
]
#: Friendly phrases.
FRIENDLY = [
    r"good\s+game", r"good\s+job", r"well\s+played", r"nice\s+game", r"nice\s+play", r"nice\s+job", r"good\s+luck", r"have\s+fun", r"good\s+try", r"no\s+worries",
    r"no\s+problem", r"all\s+good", r"thanks?\s+for\s+(?:game|playing|the\s+game)", r"gl\s+(?:next|further|hf)", r"gn\s+next", r"hf\s+gl", r"anjay\s+mabar",
    r"yuk\s+mabar", r"ayok\s+mabar", r"gas\s+mabar", r"ya\s+ma+p+", r"yama+p+", r"masuk\s+terus", r"gas\s+terus", r"lanjut\s+bro", r"full\s+chill", r"chill\s+bro",
    r"santai\s+bro", r"sabar\s+(?:bro|bang|bg)", r"tenang\s+bro", r"takpe\s+(?:bro|bang|bg|gan)", r"nice\s+\w+\s+bro", r"mantap\s+\w+", r"mantap\s+kali",
]
# fmt: on
#: What remains after the categories.
RESIDUAL: dict[str, str] = {
    "emoticon_positive": ":) :-) :d :-d =) :p :-p <3 :3 ^^ ^_^ :> =d (:",
    "emoticon_negative": ":( :-( :/ =( :< ):",
    "greeting": (
        "hi, hi all, hi guys, hi all good luck, hello, hello all, hello guys, hey, hey guys, hey all, halo, haii, haiiii, salam, bye, byee, byeee, byeeee, cya, see you, "
        "see ya, see u, morning, good morning, morn, evening, good evening, afternoon"),
    "foreign_ack": "da, нет, ni hao, ni hao ma, hola, si, oui, non, ja, nein, wala, meron, opo, oo, hindi, yes sir, no sir",
    "unknown": "kale, kalee, ka le, dx, ts, wsp, ne, nya, ya, y2, tu, ge, gege",
    "sport_loose": "gl, hf, wp, gj, np, ty, thx, thanks, tysm, tyvm, glhf, gz, gratz, congrats, grats, respect, respects, nice, good, well",
}
SYMBOLS = r"""^[.,:;!?\-_=+*&^%#@$~`\\()\[\]{}<>/]+$"""
REPEATED = r"^((hf){2,6}|(gl){2,6}|(gn){2,6}|(gj){2,6}|(ty){2,6}|(thx){2,6})$"
EDGE = ",.!?\"'"


def load_tables(path: str | None = None) -> dict[str, list[str]]:
    """The word tables; those of a JSON file (name: list of words) replace the shipped ones of the same names."""
    tables = {k: v.split(", ") for k, v in WORDS.items()}
    if path:
        with open(path, encoding="utf-8") as f:
            tables |= {k: list(v) for k, v in json.load(f).items()}
    return tables


def message_label(key: Column, time: Column, duration: Column, outcome: Column, tables: Mapping[str, list[str]] | None = None) -> Column:
    """struct(category, sentiment, one int per kind of toxicity, is_jargon, is_ambiguous); null where no category applies, and for null texts."""
    w = tables or load_tables()
    raw = F.coalesce(key, F.lit(""))
    full, strict = T.norm_full(raw), T.norm_strict(raw)
    parts = F.filter(F.split(full, " "), lambda x: x != "")
    clean = F.transform(parts, lambda x: F.regexp_replace(x, r"""^[,.!?"']+|[,.!?"']+$""", ""))
    n, first = F.size(parts), F.try_element_at(clean, F.lit(1))
    of = lambda c, name: c.isin(w[name])
    some = lambda name: F.exists(clean, lambda x: x.isin(w[name]))
    exact = lambda name: of(full, name) | strict.isin(sorted({x.replace(" ", "") for x in w[name]}))
    either = lambda name: of(full, name) | of(strict, name)
    won, lost = F.coalesce(outcome == "win", F.lit(False)), F.coalesce(outcome == "loss", F.lit(False))
    letters = T.alpha_tokens(raw)
    blocked = F.exists(letters, lambda x: x.isin(w["insult"] + w["obscene"] + w["foreign"]))
    few = n.between(1, 6) & ~blocked
    ratio = F.when(duration > 0, time / duration)

    def label(name: str, sentiment: str, flags: tuple[str, ...] = (), jargon=0, ambiguous=0, identity=None) -> Column:
        of_flag = lambda f: identity.cast("int") if f == "identity_hate" and identity is not None else F.lit(int(f in flags))
        lit = lambda x: x.cast("int") if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(name).alias("category"), F.lit(sentiment).alias("sentiment"), *[of_flag(f).alias(f) for f in TOX], lit(jargon).alias("is_jargon"), lit(ambiguous).alias("is_ambiguous"))

    bad = ("toxic", "obscene", "insult")
    alone = of(strict, "foreign")
    spelled = n.between(1, 12) & some("foreign")
    twisted = raw.rlike("(?i)" + "|".join(FUZZY + PHRASES))
    slur = F.when(alone, of(strict, "identity")).when(spelled, some("identity")).otherwise(False)
    swears = n.between(1, 4) & of(first, "obscene")
    gg = few & of(first, "gg_start")
    rules = [
        (alone | spelled | twisted, label("toxic_foreign", "negative", bad, identity=slur)),
        (of(strict, "insult") | (n.between(1, 4) & some("insult")), label("insult", "negative", ("toxic", "insult"))),
        (of(strict, "ez") & won, label("ez", "negative", ("toxic", "insult"))),
        (of(strict, "ez"), label("ez", "negative", ambiguous=1)),
        (of(strict, "ff") & lost, label("ff", "negative")),
        (of(strict, "ff") & won, label("ff", "negative", ("toxic",), ambiguous=1)),
        (of(strict, "ff"), label("ff", "negative", ambiguous=1)),
        (of(strict, "obscene"), label("obscene", "negative", ("obscene",), ambiguous=1)),
        (swears & of(F.try_element_at(clean, F.lit(2)), "target"), label("obscene", "negative", bad)),
        (swears, label("obscene", "negative", ("obscene",), ambiguous=1)),
        (exact("init"), label("init", "neutral", jargon=1, ambiguous=strict == "g")),
        (exact("coord"), label("coord", "neutral", jargon=1, ambiguous=either("coord_ambiguous"))),
        (exact("apology"), label("apology", "positive")),
        (exact("ack"), label("ack", "neutral", ambiguous=either("ack_ambiguous"))),
        (exact("timer"), label("timer", "neutral")),
        (exact("tech"), label("tech", "neutral")),
        (strict.rlike("^x+d+$"), label("xd", "positive", ambiguous=1)),
        (strict.rlike(REPEATED), label("sport_rep", "positive")),
        (exact("sport"), label("sport", "positive")),
        (exact("gg_phonetic"), label("gg_phonetic", "positive", jargon=1)),
        (gg & (ratio >= 0.95), label("gg_compound", "positive", jargon=1)),
        (gg & (ratio < 0), label("gg_compound", "neutral", jargon=1, ambiguous=1)),
        (gg, label("gg_compound", "positive", jargon=1, ambiguous=1)),
        (~blocked & raw.rlike(r"(?i)\b(?:" + "|".join(FRIENDLY) + r")\b"), label("sport_compound", "positive")),
        (few & some("sport_token"), label("sport_compound", "positive")),
        (few & some("apology_token"), label("apology_compound", "positive", ambiguous=1)),
        (few & some("tech_token"), label("tech_compound", "neutral")),
        (either("react_negative"), label("react", "negative", ambiguous=1)),
        (either("react_loss"), label("react", "neutral", ambiguous=1)),
        (raw.rlike(r"[!?]") & raw.rlike(r"^[!?.,~\s]+$"), label("punct", "neutral", ambiguous=1)),
    ]
    out = None
    for when, value in reversed(rules):
        held = F.coalesce(when, F.lit(False))
        out = F.when(held, value) if out is None else F.when(held, value).otherwise(out)
    return F.when(key.isNotNull(), out)


def message_label_sql(table: str, tables: Mapping[str, list[str]] | None = None) -> str:
    """The categories in DuckDB's SQL: all columns of ``table`` plus category, sentiment, flags, is_jargon, is_ambiguous."""
    w = tables or load_tables()
    q = lambda x: "'" + x.replace("'", "''") + "'"
    lst = lambda xs: "[" + ", ".join(map(q, xs)) + "]"
    isin = lambda c, name: f"list_contains({lst(w[name])}, {c})"
    some = lambda name: f"list_has_any(cl, {lst(w[name])})"
    exact = lambda name: f"({isin('fu', name)} OR list_contains({lst(sorted({x.replace(' ', '') for x in w[name]}))}, st))"
    either = lambda name: f"({isin('fu', name)} OR {isin('st', name)})"
    few, won, lost = "(n BETWEEN 1 AND 6 AND NOT blocked)", "coalesce(match_outcome_for_player = 'win', false)", "coalesce(match_outcome_for_player = 'loss', false)"
    swears, gg = f"(n BETWEEN 1 AND 4 AND {isin('cl[1]', 'obscene')})", f"({few} AND {isin('cl[1]', 'gg_start')})"
    foreign = f"({isin('st', 'foreign')} OR (n BETWEEN 1 AND 12 AND {some('foreign')}))"
    slur = f"CASE WHEN {isin('st', 'foreign')} THEN {isin('st', 'identity')} ELSE n BETWEEN 1 AND 12 AND {some('foreign')} AND {some('identity')} END"
    # condition, category, sentiment, flags, identity, jargon, ambiguous
    rules = [
        (f"{foreign} OR regexp_matches(raw, {q('(?i)' + '|'.join(FUZZY + PHRASES))})", "toxic_foreign", "negative", "toxic obscene insult", slur, "0", "0"),
        (f"{isin('st', 'insult')} OR (n BETWEEN 1 AND 4 AND {some('insult')})", "insult", "negative", "toxic insult", "false", "0", "0"),
        (f"{isin('st', 'ez')} AND {won}", "ez", "negative", "toxic insult", "false", "0", "0"),
        (isin("st", "ez"), "ez", "negative", "", "false", "0", "1"),
        (f"{isin('st', 'ff')} AND {lost}", "ff", "negative", "", "false", "0", "0"),
        (f"{isin('st', 'ff')} AND {won}", "ff", "negative", "toxic", "false", "0", "1"),
        (isin("st", "ff"), "ff", "negative", "", "false", "0", "1"),
        (isin("st", "obscene"), "obscene", "negative", "obscene", "false", "0", "1"),
        (f"{swears} AND n >= 2 AND {isin('cl[2]', 'target')}", "obscene", "negative", "toxic obscene insult", "false", "0", "0"),
        (swears, "obscene", "negative", "obscene", "false", "0", "1"),
        (exact("init"), "init", "neutral", "", "false", "1", "(st = 'g')::INT"),
        (exact("coord"), "coord", "neutral", "", "false", "1", f"{either('coord_ambiguous')}::INT"),
        (exact("apology"), "apology", "positive", "", "false", "0", "0"),
        (exact("ack"), "ack", "neutral", "", "false", "0", f"{either('ack_ambiguous')}::INT"),
        (exact("timer"), "timer", "neutral", "", "false", "0", "0"),
        (exact("tech"), "tech", "neutral", "", "false", "0", "0"),
        ("regexp_full_match(st, 'x+d+')", "xd", "positive", "", "false", "0", "1"),
        (f"regexp_matches(st, {q(REPEATED)})", "sport_rep", "positive", "", "false", "0", "0"),
        (exact("sport"), "sport", "positive", "", "false", "0", "0"),
        (exact("gg_phonetic"), "gg_phonetic", "positive", "", "false", "1", "0"),
        (f"{gg} AND duration > 0 AND time / duration >= 0.95", "gg_compound", "positive", "", "false", "1", "0"),
        (f"{gg} AND duration > 0 AND time / duration < 0", "gg_compound", "neutral", "", "false", "1", "1"),
        (gg, "gg_compound", "positive", "", "false", "1", "1"),
        (f"(NOT blocked AND regexp_matches(raw, {q('(?i)' + chr(92) + 'b(?:' + '|'.join(FRIENDLY) + ')' + chr(92) + 'b')})) OR ({few} AND {some('sport_token')})", "sport_compound", "positive", "", "false", "0", "0"),
        (f"{few} AND {some('apology_token')}", "apology_compound", "positive", "", "false", "0", "1"),
        (f"{few} AND {some('tech_token')}", "tech_compound", "neutral", "", "false", "0", "0"),
        (either("react_negative"), "react", "negative", "", "false", "0", "1"),
        (either("react_loss"), "react", "neutral", "", "false", "0", "1"),
        ("regexp_matches(raw, '[!?]') AND regexp_full_match(raw, '[!?.,~\\s]+')", "punct", "neutral", "", "false", "0", "1"),
    ]
    no = "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN {i}" for i, (c, *_) in enumerate(rules)) + " ELSE -1 END"
    pick = lambda k, quote=False: "CASE rule " + " ".join(f"WHEN {i} THEN {q(r[k]) if quote else r[k]}" for i, r in enumerate(rules)) + " END"
    flag = lambda f: "CASE rule " + " ".join(f"WHEN {i} THEN " + (f"coalesce({r[4]}, false)::INT" if f == "identity_hate" else str(int(f in r[3].split()))) for i, r in enumerate(rules)) + f" END AS {f}"
    strip = f"regexp_replace(lower(raw), {q(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"
    return f"""(SELECT * EXCLUDE (raw, fu, st, cl, n, blocked, rule), {pick(1, True)} AS category, {pick(2, True)} AS sentiment_label, {", ".join(flag(f) for f in TOX)}, {pick(5)} AS is_jargon, {pick(6)} AS is_ambiguous FROM (
  SELECT *, {no} AS rule FROM (SELECT *, len(cl) AS n, list_has_any(regexp_extract_all(lower(raw), '[a-z]+'), {lst(w["insult"] + w["obscene"] + w["foreign"])}) AS blocked FROM (
    SELECT *, list_transform(list_filter(string_split(fu, ' '), lambda x: x <> ''), lambda x: trim(x, {q(EDGE)})) AS cl FROM (
      SELECT *, regexp_replace({strip}, {q(T.SPACE + '+')}, ' ', 'g') AS fu, regexp_replace(lower(raw), '[!.?,~\\s"'']+', '', 'g') AS st FROM (SELECT *, coalesce(key, '') AS raw FROM {table}))))))"""


def residual_tables(tables: Mapping[str, list[str]] | None = None, game: list[str] | None = None) -> dict[str, list[str]]:
    """The tables of ``residual_label``; ``game``: names of the game's heroes and items (default: the single words of the coordination table)."""
    w = dict(tables or load_tables())
    r = {k: v.split(" " if k.startswith("emoticon") else ", ") for k, v in RESIDUAL.items()}
    return w | r | {"game": game if game is not None else sorted({x for x in w["coord"] if " " not in x and x.isalpha()})}


def residual_label(key: Column, tables: Mapping[str, list[str]] | None = None) -> Column:
    """struct(category, sentiment, confidence in high, medium, low, ASK) for messages that no category caught; null for null and blank ones.

    First what is sure by its form, then unknown shorthand (ASK), then words of abuse, courtesy, apology, technical trouble or the game inside a
    longer message (medium), then talk (low).
    """
    w = tables or residual_tables()
    raw = F.coalesce(key, F.lit(""))
    bare, full, strict = T.strip(raw), T.norm_full(raw), T.norm_strict(raw)
    parts = F.filter(F.split(full, " "), lambda x: x != "")
    clean = F.transform(parts, lambda x: F.regexp_replace(x, r"""^[,.!?"']+|[,.!?"']+$""", ""))
    letters, n = T.alpha_tokens(raw), F.size(parts)
    exact = lambda name: full.isin(w[name]) | strict.isin(sorted({x.replace(" ", "") for x in w[name]}))
    some = lambda name: F.exists(clean, lambda x: x.isin(w[name]))
    of_game = F.exists(letters, lambda x: x.isin(w["game"]))
    only_game = F.size(letters).between(1, 4) & F.forall(letters, lambda x: x.isin(w["game"]))
    say = lambda *x: F.struct(*[F.lit(v).alias(k) for k, v in zip(("category", "sentiment", "confidence"), x, strict=True)])
    return (
        F.when(bare == "", None).when(bare.rlike(SYMBOLS), say("symbols", "neutral", "high")).when(exact("emoticon_positive"), say("emoticon", "positive", "high"))
        .when(exact("emoticon_negative"), say("emoticon", "negative", "high")).when(bare.rlike("^[a-zA-Z]$"), say("letter", "neutral", "high"))
        .when(exact("greeting"), say("greeting", "positive", "high")).when(exact("foreign_ack"), say("foreign_ack", "neutral", "high"))
        .when(bare.rlike(r"^[0-9\s.,]+$"), say("numbers", "neutral", "high")).when(only_game, say("game_only", "neutral", "high"))
        .when(strict.contains("gwr") & (F.length(strict) <= 6), say("unknown", "neutral", "ASK")).when(strict.isin(w["unknown"]), say("unknown", "neutral", "ASK"))
        .when(F.exists(letters, lambda x: x.isin(w["insult"] + w["obscene"] + w["foreign"])), say("abuse", "negative", "medium"))
        .when((n <= 10) & some("apology_token"), say("apology", "positive", "medium")).when((n <= 10) & some("sport_loose"), say("sport", "positive", "medium"))
        .when((n <= 10) & some("tech_token"), say("tech", "neutral", "medium")).when(of_game & (n <= 8), say("game", "neutral", "medium"))
        .otherwise(F.when(n >= 6, say("long_talk", "neutral", "low")).otherwise(say("talk", "neutral", "low")))
    )


def residual_label_sql(table: str, tables: Mapping[str, list[str]] | None = None) -> str:
    """key, category, sentiment, confidence of ``residual_label`` in DuckDB's SQL."""
    w = tables or residual_tables()
    q = lambda x: "'" + x.replace("'", "''") + "'"
    lst = lambda xs: "[" + ", ".join(map(q, xs)) + "]"
    exact = lambda name: f"(list_contains({lst(w[name])}, fu) OR list_contains({lst(sorted({x.replace(' ', '') for x in w[name]}))}, st))"
    some = lambda name: f"list_has_any(cl, {lst(w[name])})"
    rules = [
        ("bare = ''", None, None, None), (f"regexp_matches(bare, {q(SYMBOLS)})", "symbols", "neutral", "high"), (exact("emoticon_positive"), "emoticon", "positive", "high"),
        (exact("emoticon_negative"), "emoticon", "negative", "high"), ("regexp_full_match(bare, '[a-zA-Z]')", "letter", "neutral", "high"), (exact("greeting"), "greeting", "positive", "high"),
        (exact("foreign_ack"), "foreign_ack", "neutral", "high"), ("regexp_full_match(bare, '[0-9\\s.,]+')", "numbers", "neutral", "high"),
        (f"len(al) BETWEEN 1 AND 4 AND len(list_filter(al, lambda x: list_contains({lst(w['game'])}, x))) = len(al)", "game_only", "neutral", "high"),
        (f"(contains(st, 'gwr') AND length(st) <= 6) OR list_contains({lst(w['unknown'])}, st)", "unknown", "neutral", "ASK"),
        (f"list_has_any(al, {lst(w['insult'] + w['obscene'] + w['foreign'])})", "abuse", "negative", "medium"), (f"len(cl) <= 10 AND {some('apology_token')}", "apology", "positive", "medium"),
        (f"len(cl) <= 10 AND {some('sport_loose')}", "sport", "positive", "medium"), (f"len(cl) <= 10 AND {some('tech_token')}", "tech", "neutral", "medium"),
        (f"len(cl) <= 8 AND list_has_any(al, {lst(w['game'])})", "game", "neutral", "medium"), ("len(cl) >= 6", "long_talk", "neutral", "low"), ("true", "talk", "neutral", "low"),
    ]
    pick = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN {'NULL' if r[k] is None else q(r[k])}" for r in rules) + " END"
    strip = lambda c: f"regexp_replace({c}, {q(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"
    return f"""(SELECT key, {pick(1)} AS category, {pick(2)} AS sentiment, {pick(3)} AS confidence FROM (
  SELECT *, list_transform(list_filter(string_split(fu, ' '), lambda x: x <> ''), lambda x: trim(x, {q(EDGE)})) AS cl FROM (
    SELECT key, {strip('raw')} AS bare, regexp_replace({strip('lower(raw)')}, {q(T.SPACE + '+')}, ' ', 'g') AS fu, regexp_replace(lower(raw), '[!.?,~\\s"'']+', '', 'g') AS st,
      regexp_extract_all(lower(raw), '[a-z]+') AS al FROM (SELECT key, coalesce(key, '') AS raw FROM {table}))))"""
