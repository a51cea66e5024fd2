"""A tranche of the 191 short-period price-volume alphas on daily bars (fixed published formulas)."""

from __future__ import annotations

from tickloom.functions.factor import (
    Factor, absolute, col, const, corr, count_true, decay, delay, delta, emax, emin, filled, highest, ln, lowest,
    mean, only, power, rank, returns, since_high, since_low, sign, sma, sqrt, std, sum_if, total, ts_rank, where,
)

O, H, L, C, V, A = (col(c) for c in ("open", "high", "low", "close", "volume", "amount"))
NIL = const(0.0)


def gtja() -> dict[str, Factor]:
    vwap = A / only(V > NIL, V)
    vwap = where(filled(V, 0.0) <= NIL, C, vwap)
    pc = delay(C, 1)
    ret = returns(C)
    mid, typical = (H + L) / 2.0, (H + L + C) / 3.0
    clv = ((C - L) - (H - C)) / (H - L)
    up, down = pc < C, C < pc
    m6, m12, m24 = mean(C, 6), mean(C, 12), mean(C, 24)
    d5, d6, d20 = delay(C, 5), delay(C, 6), delay(C, 20)
    rsv = (C - lowest(L, 9)) / (highest(H, 9) - lowest(L, 9)) * 100.0
    k3 = sma(rsv, 3, 1)
    hi6, lo6 = highest(H, 6), lowest(L, 6)
    rise, fall = delta(H, 1), -delta(L, 1)
    plus, minus = where(fall < rise, emax(rise, 0.0), 0.0), where(rise < fall, emax(fall, 0.0), 0.0)
    reach = emax(H - L, emax(absolute(pc - H), absolute(pc - L)))
    dv, hl = delta(V, 1), sma(H - L, 10, 2)
    triple = sma(sma(sma(ln(C), 13, 2), 13, 2), 13, 2)
    mt = mean(typical, 12)
    c15 = sma(C, 15, 2)
    gap6 = (C - m6) / m6
    return {
        "gtja001": -corr(rank(delta(ln(V), 1)), rank((C - O) / O), 6),
        "gtja002": -delta(clv, 1),
        "gtja003": total(where(up, C - emin(pc, L), 0.0) + where(down, C - emax(pc, H), 0.0), 6),
        "gtja005": -highest(corr(ts_rank(V, 5), ts_rank(H, 5), 5), 3),
        "gtja006": -rank(sign(delta(O * 0.85 + H * 0.15, 4))),
        "gtja008": -rank(delta(mid * 0.2 + vwap * 0.8, 4)),
        "gtja009": sma((mid - (delay(H, 1) + delay(L, 1)) / 2.0) * (H - L) / V, 7, 2),
        "gtja011": total(clv * V, 6),
        "gtja012": rank(O - mean(vwap, 10)) * -rank(absolute(C - vwap)),
        "gtja013": sqrt(emax(H * L, 0.0)) - vwap,
        "gtja014": C - d5,
        "gtja015": O / pc - 1.0,
        "gtja016": -highest(rank(corr(rank(V), rank(vwap), 5)), 5),
        "gtja018": C / d5,
        "gtja019": where(C < d5, (C - d5) / d5, where(C.eq(d5), 0.0, (C - d5) / C)),
        "gtja020": (C - d6) / d6 * 100.0,
        "gtja022": sma(gap6 - delay(gap6, 3), 12, 1),
        "gtja024": sma(C - d5, 5, 1),
        "gtja025": -rank(delta(C, 7) * (1.0 - rank(decay(V / mean(V, 20), 9)))) * (1.0 + rank(total(ret, 244))),
        "gtja028": 3.0 * k3 - 2.0 * sma(k3, 3, 1),
        "gtja029": (C - d6) / d6 * V,
        "gtja031": (C - m12) / m12 * 100.0,
        "gtja032": -total(rank(corr(rank(H), rank(V), 3)), 3),
        "gtja034": m12 / C,
        "gtja036": rank(total(corr(rank(V), rank(vwap), 6), 2)),
        "gtja038": where(total(H, 20) / 20.0 < H, -delta(H, 2), 0.0),
        "gtja040": sum_if(V, up, 26) / sum_if(V, C <= pc, 26) * 100.0,
        "gtja042": -rank(std(H, 10)) * corr(H, V, 10),
        "gtja046": (mean(C, 3) + m6 + m12 + m24) / (4.0 * C),
        "gtja047": sma((hi6 - C) / (hi6 - lo6) * 100.0, 9, 1),
        "gtja049": total(minus, 12) / (total(minus, 12) + total(plus, 12)),
        "gtja052": total(emax(H - delay(typical, 1), 0.0), 26) / total(emax(delay(typical, 1) - L, 0.0), 26) * 100.0,
        "gtja053": count_true(up, 12) / 12.0 * 100.0,
        "gtja057": k3,
        "gtja058": count_true(up, 20) / 20.0 * 100.0,
        "gtja060": total(clv * V, 20),
        "gtja062": -corr(H, rank(V), 5),
        "gtja066": gap6 * 100.0,
        "gtja070": std(A, 6),
        "gtja071": (C - m24) / m24 * 100.0,
        "gtja078": (typical - mt) / (0.015 * mean(absolute(C - mt), 12)),
        "gtja088": (C - d20) / d20 * 100.0,
        "gtja093": sum_if(emax(O - L, O - delay(O, 1)), O >= delay(O, 1), 20),
        "gtja096": sma(k3, 3, 1),
        "gtja097": std(V, 10),
        "gtja100": std(V, 20),
        "gtja102": sma(emax(dv, 0.0), 6, 1) / sma(absolute(dv), 6, 1) * 100.0,
        "gtja106": C - d20,
        "gtja109": hl / sma(hl, 10, 2),
        "gtja111": sma(V * clv, 11, 2) - sma(V * clv, 4, 2),
        "gtja118": total(H - O, 20) / total(O - L, 20) * 100.0,
        "gtja122": (triple - delay(triple, 1)) / delay(triple, 1),
        "gtja126": typical,
        "gtja129": total(where(down, absolute(C - pc), 0.0), 12),
        "gtja133": (20.0 - since_high(H, 20)) / 20.0 * 100.0 - (20.0 - since_low(L, 20)) / 20.0 * 100.0,
        "gtja150": typical * V,
        "gtja158": ((H - c15) - (L - c15)) / C,
        "gtja167": total(emax(C - pc, 0.0), 12),
        "gtja168": -(V / mean(V, 20)),
        "gtja171": -(L - C) * power(O, 5.0) / ((C - H) * power(C, 5.0)),
        "gtja175": mean(reach, 6),
        "gtja187": sum_if(emax(H - O, O - delay(O, 1)), O > delay(O, 1), 20),
        "gtja189": mean(absolute(C - m6), 6),
        "gtja191": corr(mean(V, 20), L, 5) + mid - C,
    }
