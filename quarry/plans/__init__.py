"""Plans: the registered queries, each an operator applied to whole tables, with the SQL that says the same."""
