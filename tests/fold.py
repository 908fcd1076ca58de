"""A plain sequential order book, written from the rules, to hold the windows against."""

from collections import defaultdict


def fold(events):
    """(log rows as (event_id, reason, order_id, ref_side, requested, remaining), {quote event_id: {side: [(price, qty)]}})."""
    resting, log, books = {}, [], {}

    def take(e, oid, qty, why, ref, required):
        if oid not in resting:
            if required:
                log.append((e["event_id"], why, oid, ref, None, None))
            return
        side, price, left = resting[oid]
        got = min(left, qty)
        if got < qty:
            log.append((e["event_id"], "qty_shortfall", oid, ref, qty, got))
        if left > got:
            resting[oid] = (side, price, left - got)
        else:
            del resting[oid]

    for e in sorted(events, key=lambda x: x["event_id"]):
        kind, qty = e["event_type"], e.get("qty")
        if kind == "order_add":
            oid, side = (e["exchange_order_id"] or "").strip(), (e["side"] or "").strip().upper()
            if oid and side in ("B", "S") and e["price_int"] is not None and (qty or 0) > 0:
                resting[oid] = (side, e["price_int"], qty)
            else:
                log.append((e["event_id"], "invalid_order_add", oid, None, None, None))
        elif kind == "order_cancel":
            oid = (e["exchange_order_id"] or "").strip()
            if oid and (qty or 0) > 0:
                take(e, oid, qty, "missing_cancel_order", None, True)
            else:
                log.append((e["event_id"], "invalid_order_cancel", oid, None, None, None))
        elif kind == "trade":
            if (qty or 0) <= 0:
                log.append((e["event_id"], "invalid_trade_qty", None, None, None, None))
                continue
            legs = [("ask", (e["ask_order_id"] or "").strip()), ("bid", (e["bid_order_id"] or "").strip())]
            by = (e["aggressor_side"] or "").strip().upper()
            if by == "S":
                legs.reverse()
            for k, (ref, oid) in enumerate(legs):
                if by in ("B", "S") or oid:
                    take(e, oid, qty, "missing_trade_order", ref, k == 0 or by not in ("B", "S"))
        elif kind == "quote":
            level = defaultdict(int)
            for side, price, left in resting.values():
                level[side, price] += left
            books[e["event_id"]] = {s: sorted(((p, q) for (x, p), q in level.items() if x == s), reverse=s == "B")[:10] for s in "BS"}
    return log, books
