from brandsieve.llm import langid


def test_every_language_is_learned(make, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 1)
    rows = [(n, f"{chr(97 + n % 26)}{chr(97 + n // 26 % 26)} word {n % 70}", f"l{n % 70:02}") for n in range(1400)]
    rows += [(n, "only one row", "rare") for n in range(2000, 2040) if n == 2001]
    assert langid.train(make(rows)).languages == [*sorted({r[2] for r in rows})]
    monkeypatch.setattr(langid, "ROWS", 70)  # one row for each
    assert langid.train(make(rows)).languages == [*sorted({r[2] for r in rows})]
