"""Plans: from metric specifications to metric rows, and the registered queries."""
