"""The registered queries of the document pipeline and their SQL."""

from docpipe.plans import content, inventory, more, rules, state

QUERIES = {**inventory.QUERIES, **state.QUERIES, **rules.QUERIES, **content.QUERIES, **more.QUERIES}
SQL = {**inventory.SQL, **state.SQL, **rules.SQL, **content.SQL, **more.SQL}
