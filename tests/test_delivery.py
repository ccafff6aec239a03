"""Deliveries that are replayed, fail and die."""

import pytest

from folia.streaming import delivery

MAILS = "digest_id string, email string"


def test_nothing_is_sent_twice(spark, tmp_path):
    log, folder = tmp_path / "log", f"file://{tmp_path}/ledger"

    def send(message_id, digest_id, address):
        with open(log, "a") as file:
            file.write(f"{digest_id} {address}\n")
        return "full" if address == "c@x" else None

    mails = spark.createDataFrame([("1", "A@x "), ("1", "a@x"), ("2", "a@x"), ("1", "c@x"), ("1", " "), ("1", None), (None, "a@x")], MAILS)
    one = delivery.deliver(folder, "r", send)
    one(mails, 0)
    assert sorted(log.read_text().split("\n")[:-1]) == ["1 a@x", "1 c@x", "2 a@x"]
    one(mails, 0)
    assert len(log.read_text().split("\n")) == 4
    # a later batch, and another run, try only what failed, and what is new
    one(mails, 1)
    delivery.deliver(folder, "s", send)(mails.unionByName(spark.createDataFrame([("2", "d@x")], MAILS)), 0)
    assert sorted(log.read_text().split("\n")[4 - 1 : -1]) == ["1 c@x", "1 c@x", "2 d@x"]
    states = {tuple(r) for r in delivery.deliveries(delivery.ledger(spark, folder)).collect()}
    assert states == {("1", "a@x", "sent", None, 1), ("2", "a@x", "sent", None, 1), ("1", "c@x", "failed", "full", 0), ("2", "d@x", "sent", None, 1)}


def test_a_batch_that_dies_is_sent_when_it_comes_again(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    mails = spark.createDataFrame([("1", "a@x")], MAILS)

    def dies(message_id, digest_id, address):
        raise OSError("gone")

    with pytest.raises(Exception, match="gone"):
        delivery.deliver(folder, "r", dies)(mails, 0)
    assert delivery.ledger(spark, folder).count() == 0
    delivery.deliver(folder, "r", lambda *_: None)(mails, 0)
    assert [r.status for r in delivery.ledger(spark, folder).collect()] == ["sent"]
    delivery.deliver(folder, "r", dies)(spark.createDataFrame([], MAILS), 1)
    assert delivery.due(mails, delivery.ledger(spark, folder)).count() == 0
