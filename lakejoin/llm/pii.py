"""Format-preserving Feistel pseudonyms for personal data (DataFrame functions only).

One pattern finds candidates; a candidate counts only if it validates:

* ``card``  13 to 19 digits with a right Luhn check digit, in one run or in
  groups of three and more (the last of one and more) with single spaces or
  hyphens between them: all but the check digit are permuted, the check digit is
  computed anew, the separators are put back.  In a longer run of groups the
  first and shortest groups that validate are a card;
* ``phone`` numbers with +: the country code stays, the other digits are
  permuted; ddd-ddd-dddd with spaces, dots, hyphens or (ddd), with or without 1:
  the ten digits are permuted; 9 to 12 digits with a leading 0 and a separator:
  ten are permuted, otherwise all but the 0.  The layout stays;
* ``ssn``   ddd-dd-dddd with an assignable area, group and serial: permuted
  until the result is assignable again (cycle walking);
* ``ip``    four octets up to 255: the 32 bits are permuted;
* ``date``  year first (-, / or .) or last (., - with the day first, / with the
  month first, the other way round if only that is a day), day and month of one
  or two digits, a real day from 1900 to 2099: the day number is permuted within
  that range (cycle walking).  Years of two digits (dd.mm.yy, m/d/yy) mean 1950
  to 2049 and stay within it.  A day that is written in the other order keeps it
  where it can only be read so;
* ``email`` the local part becomes a keyed digest of 128 bits; the domain stays.

Not searched, as nothing tells them from other numbers: telephone numbers in one
run without +, or without an area code; cards in groups of one or two digits.

The permutation is a balanced Feistel network of ten rounds over two halves of
the number; the round function is SHA-256 of key, kind, length, round and half.
It depends on key, kind and value alone, so equal values get equal pseudonyms
in every document and different values never share one.  There is no shuffle.

Edge cases: a null text stays null with no findings; texts without a digit or
``@`` are not searched; candidates that do not validate stay as they are;
other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejoin.llm import shared

ROUNDS = 10
WALK = 64             # steps of cycle walking; the chance that they do not do is below 1e-20
DAYS = 73049          # 1900-01-01 .. 2099-12-31
SHORT = 18262, 54786  # 1950-01-01 and 2049-12-31, the days of years of two digits
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_YY = rf"{_END}(?![./][0-9])"
_SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
_IP = "[0-9]{1,3}(?:[.][0-9]{1,3}){3}"
_DATE = ("(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{4}[.][0-9]{1,2}[.][0-9]{1,2}"
         "|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"
         f"|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}{_YY}|[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{2}}{_YY})")
_TEN = ("(?:(?:1[ .-])?(?:[(][0-9]{3}[)] ?|[0-9]{3}-)[0-9]{3}[ .-][0-9]{4}"
        "|(?:1[ .-])?[2-9][0-9]{2}[ .][2-9][0-9]{2}[ .-][0-9]{4})")
_OTHER = f"(?!(?:{_SSN}|{_IP}|{_DATE}|{_TEN}){_END})"
_ZERO = (f"(?=[(]?0(?:[()/ -]{{0,2}}[0-9]){{8,11}}{_END})(?:[(]0[0-9]{{1,4}}[)] ?|0[0-9]{{1,4}}[ /-])"
         f"{_OTHER}[0-9]{{2,8}}(?:[ -]{_OTHER}[0-9]{{2,8}}){{0,4}}")
_PLUS = ("[+](?:1(?:[ .-]?[(]?[0-9][)]?){10}"
         f"|[2-9](?:(?:[ .-](?!(?:{_SSN}|{_IP}|{_DATE}){_END}))?[(]?[0-9][)]?){{6,15}})")
_GROUPS = (f"(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]{{3,12}}(?:[ -]{_OTHER}(?!{_ZERO}{_END})[0-9]{{1,12}}{_END})++")
PATTERN = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    rf"|\+1 \([0-9]{{3}}\) [0-9]{{3}}-[0-9]{{4}}{_END}"
    rf"|{_EDGE}(?:{_PLUS}|{_SSN}|{_IP}|{_DATE}|{_TEN}|{_ZERO}|[0-9]{{13,19}}|{_GROUPS}){_END}")
# Country codes are prefix-free: one digit, these of two digits, or three.
_COUNTRY = "^([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _half(key: str, kind: str, length: str, i: str, half: str) -> str:
    return (f"cast(conv(substr(sha2(concat_ws('|', '{key}', '{kind}', {length}, {i}, {half}), 256), 1, 15), 16, 10) as bigint)")


def _feistel(key: str, kind: str, digits: str) -> str:
    """SQL: permute a string of 2 to 18 decimal digits within its length."""
    n = f"length({digits})"
    u, v = f"cast(floor({n} / 2) as int)", f"cast({n} - floor({n} / 2) as int)"
    start = f"named_struct('a', cast(substr({digits}, 1, {u}) as bigint), 'b', cast(substr({digits}, {u} + 1) as bigint))"
    width = f"if(i % 2 = 0, {u}, {v})"
    step = (f"named_struct('a', s.b, 'b', pmod(s.a + {_half(key, kind, n, 'i', 's.b')}, cast(pow(10, {width}) as bigint)))")
    return (f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> {step}, "
            f"s -> concat(lpad(cast(s.a as string), {u}, '0'), lpad(cast(s.b as string), {v}, '0')))")


def _feistel_bits(key: str, value: str) -> str:
    """SQL: permute a 32-bit number."""
    step = f"named_struct('a', s.b, 'b', pmod(s.a + {_half(key, 'ip', '32', 'i', 's.b')}, 65536L))"
    return (f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', shiftright({value}, 16), 'b', {value} & 65535L), "
            f"(s, i) -> {step}, s -> s.a * 65536L + s.b)")


def _walk(start: str, wrong: str, step: str, most: int = WALK) -> str:
    """SQL: apply ``step`` to x until ``wrong`` no longer holds (once at least)."""
    return f"aggregate(sequence(1, {most}), {start}, (x, k) -> if(k = 1 or {wrong}, {step}, x))"


def _let(value: str, var: str, body: str) -> str:
    """SQL: ``body`` with ``var`` bound to ``value``."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def _pour(layout: str, digits: str) -> str:
    """SQL: the digits of ``layout`` replaced by ``digits``, one after the other."""
    return (f"aggregate(sequence(1, length({layout})), named_struct('k', 1, 'out', ''), (p, j) -> "
            f"if(substr({layout}, j, 1) between '0' and '9', "
            f"named_struct('k', p.k + 1, 'out', concat(p.out, substr({digits}, p.k, 1))), "
            f"named_struct('k', p.k, 'out', concat(p.out, substr({layout}, j, 1)))), p -> p.out)")


def _digits(h: str) -> str:
    return f"regexp_replace({h}, '[^0-9]', '')"


def _days(h: str) -> tuple[str, str]:
    """SQL: the day of a date as read in its usual order and in the other one."""
    p = f"split({h}, '[-/.]')"

    def day(y: int, m: int, d: int) -> str:
        year = f"if(length({p}[{y}]) = 4, {p}[{y}], concat(if({p}[{y}] < '50', '20', '19'), {p}[{y}]))"
        return f"try_cast(concat_ws('-', {year}, lpad({p}[{m}], 2, '0'), lpad({p}[{d}], 2, '0')) as date)"

    usual = f"case when {h} rlike '^[0-9]{{4}}' then {day(0, 1, 2)} when instr({h}, '/') > 0 then {day(2, 0, 1)} else {day(2, 1, 0)} end"
    other = f"case when {h} rlike '^[0-9]{{4}}' then null when instr({h}, '/') > 0 then {day(2, 1, 0)} else {day(2, 0, 1)} end"
    return usual, other


def _luhn_sum(digits: str) -> str:
    """SQL: Luhn sum of digits whose last one is doubled first."""
    return (f"aggregate(sequence(1, length({digits})), 0, (acc, j) -> acc + cast(case when j % 2 = 1 then "
            f"(cast(substr({digits}, -j, 1) as int) * 2) div 10 + (cast(substr({digits}, -j, 1) as int) * 2) % 10 "
            f"else cast(substr({digits}, -j, 1) as int) end as int))")


_SSN_WRONG = ("substr({x}, 1, 3) in ('000', '666') or substr({x}, 1, 1) = '9' or substr({x}, 4, 2) = '00' "
              "or substr({x}, 6, 4) = '0000'")


def kind_of(h: str) -> str:
    """SQL: kind of a candidate, null if it does not validate."""
    usual, other = _days(h)
    return f"""case
      when instr({h}, '@') > 0 then 'email'
      when {h} like '+%' then 'phone'
      when {h} rlike '^[0-9]{{13,19}}$' then if({_luhn(h)}, 'card', null)
      when {h} rlike '^{_SSN}$' then if({_SSN_WRONG.format(x=f"replace({h}, '-', '')")}, null, 'ssn')
      when {h} rlike '^{_IP}$' then if(forall(split({h}, '[.]'), o -> cast(o as int) <= 255), 'ip', null)
      when {h} rlike '^{_DATE}$' then
        if(coalesce({usual}, {other}) between date'1900-01-01' and date'2099-12-31', 'date', null)
      when {h} rlike '^(?:{_TEN}|{_ZERO})$' then 'phone' end"""


def _luhn(h: str) -> str:
    """SQL: does the check digit hold?"""
    return f"(({_luhn_sum(f'substr({h}, 1, length({h}) - 1)')} + cast(substr({h}, -1, 1) as int)) % 10 = 0)"


def pieces_of(h: str) -> str:
    """SQL: array of (h, kind) of a candidate; one of digit groups is cut into cards and the rest."""
    own = "slice(g, i, j - i + 1)"
    ends = (f"if(i = size(g), cast(array() as array<int>), filter(sequence(i + 1, least(i + 6, size(g))), j -> "
            f"forall(slice(g, i, j - i), y -> length(y) >= 3) and length(array_join({own}, '')) between 13 and 19 "
            f"and {_let(f"array_join({own}, '')", 'd', _luhn('d'))}))")
    after = "s.pos + length(g[i - 1]) + 1"
    card = (f"named_struct('next', e[0] + 1, 'pos', {after}, 'out', "
            f"concat(s.out, array(named_struct('at', s.pos, 'n', length(array_join({own.replace('j', 'e[0]')}, ' '))))))")
    none_yet = "named_struct('next', 1, 'pos', 1, 'out', cast(array() as array<struct<at:int,n:int>>))"
    scan = (f"aggregate(sequence(1, size(g)), {none_yet}, (s, i) -> if(i < s.next, named_struct('next', s.next, 'pos', {after}, 'out', s.out), "
            f"{_let(ends, 'e', f"if(size(e) > 0, {card}, named_struct('next', s.next, 'pos', {after}, 'out', s.out))")}), s -> s.out)")
    none = "cast(null as string)"
    before = "coalesce(get(c, n - 1).at + get(c, n - 1).n, 1)"
    last = "coalesce(get(c, size(c) - 1).at + get(c, size(c) - 1).n, 1)"
    cut = (f"flatten(transform(c, (x, n) -> array(named_struct('h', substr({h}, {before}, x.at - {before}), 'kind', {none}), "
           f"named_struct('h', substr({h}, x.at, x.n), 'kind', 'card'))))")
    tail = f"array(named_struct('h', substr({h}, {last}), 'kind', {none}))"
    groups = _let(f"split({h}, '[ -]')", "g", _let(scan, "c", f"concat({cut}, {tail})"))
    return (f"if({h} rlike '^[0-9]{{3,12}}(?:[ -][0-9]{{1,12}})++$' and length({_digits(h)}) >= 13, {groups}, "
            f"array(named_struct('h', {h}, 'kind', {kind_of(h)})))")


def pseudonym(key: str, h: str, kind: str) -> str:
    """SQL: pseudonym of a validated candidate; other candidates stay."""
    body = f"substr({_digits(h)}, 1, length({_digits(h)}) - 1)"
    card = _let(_feistel(key, "card", body), "d", _let(f"concat(d, cast((10 - {_luhn_sum('d')} % 10) % 10 as string))", "c", _pour(h, "c")))
    layout, digits = f"replace({h}, '(0)', '(o)')", _digits(f"replace({h}, '(0)', '')")
    stay = (f"case when {h} like '+%' then regexp_extract({digits}, '{_COUNTRY}', 1) when length({digits}) = 10 then '' "
            f"else substr({digits}, 1, 1) end")
    fone = _let(stay, "c", _let(f"substr({digits}, length(c) + 1)", "n", _let(
        f"concat(c, {_feistel(key, 'phone', 'n')})", "d", f"replace({_pour(layout, 'd')}, '(o)', '(0)')")))
    plain = f"replace({h}, '-', '')"
    ssn_walk = _walk(plain, _SSN_WRONG.format(x="x"), _feistel(key, "ssn", "x"))
    ssn = f"element_at(transform(array({ssn_walk}), d -> concat_ws('-', substr(d, 1, 3), substr(d, 4, 2), substr(d, 6, 4))), 1)"
    octets = f"transform(split({h}, '[.]'), o -> cast(o as bigint))"
    bits = f"aggregate({octets}, 0L, (acc, o) -> acc * 256L + o)"
    ip = (f"element_at(transform(array({_feistel_bits(key, bits)}), w -> concat_ws('.', "
          "cast(shiftright(w, 24) as string), cast(shiftright(w, 16) & 255L as string), "
          "cast(shiftright(w, 8) & 255L as string), cast(w & 255L as string))), 1)")
    usual, other = _days(h)
    start = f"lpad(cast(datediff(coalesce({usual}, {other}), date'1900-01-01') as string), 5, '0')"
    step = _feistel(key, "date", "x")
    moved = (f"if({h} rlike '[/.][0-9]{{1,2}}[/.][0-9]{{2}}$' and not {h} rlike '^[0-9]{{4}}', "
             f"{_walk(start, f'cast(x as int) not between {SHORT[0]} and {SHORT[1]}', step, 4 * WALK)}, "
             f"{_walk(start, f'cast(x as int) >= {DAYS}', step)})")
    one = f"{h} rlike '(^|[-/.])[0-9]([-/.]|$)'"            # no leading zeros
    swap = f"({usual} is null and day(t) > 12)"
    month = f"if({one}, cast(month(t) as string), lpad(cast(month(t) as string), 2, '0'))"
    mday = f"if({one}, cast(day(t) as string), lpad(cast(day(t) as string), 2, '0'))"
    year = f"if({h} rlike '[0-9]{{4}}', cast(year(t) as string), substr(cast(year(t) as string), 3, 2))"
    mark = f"regexp_extract({h}, '[-/.]', 0)"
    date = _let(moved, "d", _let("date_add(date'1900-01-01', cast(d as int))", "t", (
        f"case when {h} rlike '^[0-9]{{4}}' then concat_ws({mark}, {year}, {month}, {mday}) "
        f"when (instr({h}, '/') > 0) = {swap} then concat_ws({mark}, {mday}, {month}, {year}) "
        f"else concat_ws({mark}, {month}, {mday}, {year}) end")))
    mail = (f"concat('u', substr(sha2(concat_ws('|', '{key}', 'email', lower(substring_index({h}, '@', 1))), 256), 1, 32), "
            f"'@', substring_index({h}, '@', -1))")
    return (f"case {kind} when 'card' then {card} when 'phone' then {fone} when 'ssn' then {ssn} when 'ip' then {ip} "
            f"when 'date' then {date} when 'email' then {mail} else {h} end")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and ``pii`` (array of (kind, pseudonym)
    in text order).  ``key``: letters and digits; it is part of the plan, so keep
    plans and event logs as safe as the key."""
    if not key.isalnum():
        raise ValueError("key: letters and digits only")
    cols = docs.columns
    hits, found = shared.fresh(cols, "pii_hits"), shared.fresh(cols, "pii")
    text: Column = F.col(text_col)
    pat = F.lit(PATTERN)
    none = F.expr("cast(array() as array<string>)")
    df = docs.withColumn(hits, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, pat, F.lit(0))).otherwise(none))
    swap = F.expr(f"transform(`{hits}`, h -> transform({pieces_of('h')}, "
                  f"x -> named_struct('kind', x.kind, 'value', {pseudonym(key, 'x.h', 'x.kind')})))")
    df = df.withColumn(hits, F.when(F.size(hits) > 0, swap).otherwise(F.expr("cast(array() as array<array<struct<kind:string,value:string>>>)")))
    df = df.withColumn(found, F.filter(F.flatten(hits), lambda x: x["kind"].isNotNull()))
    pieces = F.split(text, PATTERN, -1)
    new = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.zip_with(
        F.col(hits), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda a, b: F.concat(F.array_join(F.transform(a, lambda x: x["value"]), ""), b)), ""))
    return df.withColumn(text_col, F.when(F.size(found) > 0, new).otherwise(text)).drop(hits)
