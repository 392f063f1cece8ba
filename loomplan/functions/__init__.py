"""Part of loomplan."""
