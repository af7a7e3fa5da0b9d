"""Rule packs: parsed, validated, tested by their own fixtures, deduplicated and sorted on the driver."""
