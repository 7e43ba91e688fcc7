"""Table operators: drift, rules, policies, repair statements, audit, text."""
