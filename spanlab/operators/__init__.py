"""DataFrame operators: lexer, alignment, predictors, evaluation, audit, preparation."""
