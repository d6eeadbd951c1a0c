"""Serve requests in order under several uniqueness rules at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.operators.guards import REQUEST_ORDER, turn
from wardflow.session import materialize


def accept_in_order(requests: DataFrame, claims: Sequence[str]) -> DataFrame:
    """Requests accepted when each, in its turn, must claim only unclaimed values.

    Same result as a loop over the requests, reached in rounds: whoever is first in
    line for all its values is accepted, whoever shares a value with an accepted
    request is out, the rest goes to the next round. One claim column needs a single
    pass; with several, the number of rounds is half the longest chain of requests
    that each clash with the one before, in order. NULL claims never collide.
    """
    claims = list(claims)
    waiting = requests.select(*REQUEST_ORDER, *claims)
    accepted = None
    while True:
        lined_up = waiting
        first_everywhere = F.lit(True)
        for claim in claims:
            first = (
                waiting.filter(F.col(claim).isNotNull())
                .groupBy(claim)
                .agg(F.min(turn()).alias(f"_first_{claim}"))
            )
            lined_up = lined_up.join(first, claim, "left")
            first_everywhere &= F.col(claim).isNull() | (F.col(f"_first_{claim}") == turn())
        winners = lined_up.filter(first_everywhere).select(*REQUEST_ORDER, *claims)
        if len(claims) == 1:
            return winners
        winners = materialize(winners, "accepted")
        accepted = winners if accepted is None else accepted.unionByName(winners)
        for claim in claims:
            taken = winners.select(claim).filter(F.col(claim).isNotNull())
            waiting = waiting.join(taken, claim, "left_anti")
        # A winner whose claims are all NULL is removed by its id.
        waiting = materialize(waiting.join(winners.select("request_id"), "request_id", "left_anti"), "waiting")
        if waiting.isEmpty():
            return accepted
