"""Rules in full."""

from strataloom.operators import rules


def test_all_seed_rules_are_there():
    rows = rules.rule_rows()
    assert len(rows) == 106 == len({(t, code, alias) for t, code, _, alias, *_ in rows})
    assert rules.aliases("RESPONSE")["level_1"][3] == "Ⅰ级应急响应"
