"""The steps that every configured column goes through."""
