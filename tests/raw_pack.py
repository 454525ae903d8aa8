"""A small deterministic raw source pack for end-to-end tests."""

from __future__ import annotations

import csv
import datetime as dt
import os
import random

CHANNELS = ("chat", "email", "voice", "social")


def write_pack(folder: str, tickets: int = 700, seed: int = 7) -> dict[str, list[dict]]:
    rng = random.Random(seed)
    os.makedirs(folder, exist_ok=True)
    products = [
        {"sku": f"SKU{i}", "product_name": f"Thing {i}", "family": f"F{i % 3}", "launch_date": "2024-06-01",
         "unit_cost_inr": "" if i == 5 else str(100 + 10 * i), "retail_price_inr": str(300 + i), "warranty_months": "12"}
        for i in range(6)
    ]
    agents = []
    for i in range(8):
        tier = "T1" if i < 5 else "T2"
        base = {"agent_id": f"A{i}", "name": f"Agent {i}", "site": "S1", "team": "X", "shift": "day", "tier": tier}
        if i == 0:
            agents.append(base | {"from_date": "2024-01-01", "to_date": "2025-03-31"})
            agents.append(base | {"shift": "night", "from_date": "2025-04-01", "to_date": ""})
        else:
            agents.append(base | {"from_date": "2025-01-01", "to_date": ""})
    customers = [
        {"customer_id": f"C{i}", "name": f"N{i}", "city": "X", "state": "Y", "signup_date": "2025-01-05", "care_plus": "N"}
        for i in range(60)
    ]
    orders = [
        {"order_id": f"O{i}", "customer_id": f"C{rng.randrange(60)}", "sku": f"SKU{rng.randrange(6)}",
         "order_date": f"2025-0{1 + i % 6}-0{1 + i % 9}", "channel": rng.choice(("web", "store")), "qty": "1",
         "order_value_inr": "500.50", "lot_code": f"L{i % 4}"}
        for i in range(200)
    ]
    rows = []
    for i in range(tickets):
        order = orders[rng.randrange(200)]
        created = dt.datetime(2025, 1, 6, 9, 0) + dt.timedelta(minutes=rng.randrange(170 * 24 * 60))
        first = created + dt.timedelta(minutes=rng.choice((5, 20, 100, 300, 600)))
        resolved = first + dt.timedelta(minutes=rng.randrange(5, 4000))
        status = rng.choice(("resolved", "resolved", "closed", "open"))
        done = status != "open"
        rows.append(
            {
                "ticket_id": f"T{i:05d}",
                "created_at": created.strftime("%Y-%m-%d %H:%M:%S") + ("+05:30" if i % 9 == 0 else ""),
                "first_response_at": first.strftime("%Y-%m-%d %H:%M:%S"),
                "resolved_at": resolved.strftime("%Y-%m-%d %H:%M:%S") if done else "",
                "status": status,
                "channel": CHANNELS[i % 4],
                "customer_id": order["customer_id"],
                "order_id": order["order_id"] if i % 3 else " n/a ",
                "product_sku": order["sku"],
                "category": "Billing  &  Payments",
                "priority": rng.choice(("Low", "Normal", "High")),
                "assigned_team": "X",
                "agent_id": f"A{rng.randrange(8)}",
                "transfers": str(rng.randrange(4)),
                "csat_score": rng.choice(("", "1", "2", "3", "4", "5")),
                "refund_amount_inr": rng.choice(("", "50", "99.95")),
                "refund_reason_code": "late",
                "replacement_issued": rng.choice(("Y", "N", "N")),
                "customer_message": 'My unit, it "stopped"\nworking' if i % 5 else "IVR transcript failed",
                "agent_notes": "checked cable" if i % 2 else "",
                "source_system": "legacy_fd" if i % 11 == 0 else "helpdesk",
            }
        )
    pack = {"tickets": rows, "agents": agents, "customers": customers, "orders": orders, "products": products}
    for name, data in pack.items():
        with open(f"{folder}/{name}.csv", "w", encoding="utf-8-sig", newline="") as handle:
            writer = csv.DictWriter(handle, fieldnames=list(data[0]))
            writer.writeheader()
            writer.writerows(data)
    return pack
