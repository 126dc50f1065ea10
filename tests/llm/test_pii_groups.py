"""Numbers that stand beside other numbers of the same run."""

from sigloom.llm.pii import luhn, masked, spans

CARD, OTHER, AMEX = "4111 1111 1111 1111", "4785380592391139", "3782 822463 10005"


def hidden(text: str) -> str:
    return masked(text, spans(text))


def test_cards_beside_short_numbers():
    for text, expected in {
        f"{CARD} 12/26": "[CARD] 12/26",
        f"{CARD} 123": "[CARD] 123",
        "4111111111111111 12": "[CARD] 12",
        "1 4111111111111111": "1 [CARD]",
        f"2 {AMEX} 1234": "2 [CARD] 1234",
        "4111-1111-1111-1111-123": "[CARD]-123",
        f"{CARD} 12a": "[CARD] 12a",
        f"+1 (279) 555-0216 {CARD}": "[PHONE] [CARD]",
        "2353820953013749 12": "2353820953013749 12",
    }.items():
        assert hidden(text) == expected


def test_no_neighbour_saves_a_card():
    """Whatever stands before or after, none of the card's digits stays."""
    for card in (CARD, OTHER, AMEX):
        for n in range(1000):
            for text in (f"{n} {card}", f"{card} {n}", f"{n:03d}-{card}", f"{card} {n:02d} {n}", f"{CARD} {n} {card}"):
                found = spans(text)
                at = text.rindex(card)
                assert any(a <= at and at + len(card) <= b for a, b, _ in found)


def test_a_card_that_joins_a_phone_leaves_nothing_of_it():
    text = next(t for t in (f"+1 (279) 555-{n:04d} 378282246310005" for n in range(10_000)) if luhn(t[13:].replace(" ", "")))
    assert not any(c.isdigit() for c in hidden(text))


def test_ibans_before_words_and_numbers():
    for text, expected in {
        "DE89 3704 0044 0532 0130 00 1234": "[IBAN] 1234",
        "DE89370400440532013000 1234": "[IBAN] 1234",
        "DE89 3704 0044 0532 0130 00 PAID NOW": "[IBAN] PAID NOW",
        "GB82 WEST 1234 5698 7654 32 BANK": "[IBAN] BANK",
        "ES91 2100 0418 4502 0005 1332 1234": "[IBAN] 1234",
        "AT61 1904 3002 3457 3201 PAID NOW": "[IBAN] PAID NOW",
        "NO93 8601 1117 947": "[IBAN]",
        "GB82 WEST 1234 5698 7654 33 BANK": "GB82 WEST 1234 5698 7654 33 BANK",
    }.items():
        assert hidden(text) == expected
